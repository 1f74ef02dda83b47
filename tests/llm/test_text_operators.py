"""Encoding, token counts, license scan, decontamination and archives against brute force."""
import base64
import gzip
import hashlib
import json
import random
import re
from functools import lru_cache

import public_tokenizers
import pytest
import tiktoken

from casewright.llm import bpe, decontaminate, license_scan, token_counts, warc
from casewright.llm.session import prepare, shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache
def tik():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n=80, seed=2):
    rnd, alphabet = random.Random(seed), ["a", "aa", "the", " ", "  ", "\n", "é", "🙂", "1", "23", "'s", "...", "ing", "Tion", "\t", "ab"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def frame(spark, texts, extra="ids string, decoded string, counted string"):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + extra).repartition(3)


# ------------------------------------------------------------------ byte-level BPE

def test_bpe_is_tiktoken_and_decodes_back(spark):
    texts = [None, "", " ", "a" * 300, "abab" * 50, "  \n\n x", "<|endoftext|>", *random_texts()] + ["dup"] * 3
    encoded = bpe.decode(bpe.encode(frame(spark, texts), PATH), PATH)  # the input's ids and decoded are replaced
    for r in encoded.collect():
        text = texts[r.doc_id] or ""
        assert r.ids == tik().encode_ordinary(text) and bytes(r.decoded) == text.encode()
    row = encoded.select("doc_id", *bpe.digests(encoded)).where("doc_id = 3").first()
    ids = tik().encode_ordinary(texts[3])
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.encode(frame(spark, []), PATH).count() == 0


def test_bpe_words_are_the_same_when_the_table_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    table, texts = bpe.WordTable(bpe.vocabulary(PATH), public_tokenizers.PATTERN), random_texts()
    assert [table.encode([t])[0].as_py() for t in texts] == [tik().encode_ordinary(t) for t in texts]


def test_bpe_refuses_a_vocabulary_with_unreachable_tokens(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"xyz"]
    (tmp_path / "v").write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(tokens)))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "v")).check()


# ------------------------------------------------------------------ token counts

def spans(text):
    out, at = [], 0
    raw, chars = text.encode(), []
    for i, c in enumerate(text):
        chars += [i] * len(c.encode())
    for t in tik().encode_ordinary(text):
        n = len(tik().decode_single_token_bytes(t))
        out.append((chars[at], chars[at + n - 1] + 1))
        at += n
    assert at == len(raw)
    return out


def brute_counts(text, sections, rule):
    counts, crossing, outside = [0.0] * len(sections), [0] * len(sections), 0.0
    for a, b in spans(text):
        share = {k: min(b, e) - max(a, s) for k, (s, e) in enumerate(sections) if min(b, e) > max(a, s)}
        if not share:
            outside += 1
        elif len(share) == 1:
            counts[next(iter(share))] += 1
        else:
            for k in share:
                crossing[k] += 1
            if rule == "split":
                for k, n in share.items():
                    counts[k] += n / sum(share.values())
            else:
                counts[min(share) if rule == "start" else max(share, key=lambda k: (share[k], -k))] += 1
    return counts, crossing, outside


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_equal_brute_force(spark, rule):
    rnd, rows = random.Random(5), []
    for i, t in enumerate(random_texts(50, 6)):
        cuts = sorted(rnd.sample(range(len(t) + 4), min(6, len(t) + 2)))
        rows.append((i, t, [(a, b) for a, b in zip(cuts[::2], cuts[1::2])], "x"))
    rows += [(90, None, [(0, 3)], "x"), (91, "abc def", None, "x"), (92, "abc", [(0, 0), (1, 1)], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>, counted string")
    for r in token_counts.attribute(docs, PATH, sections="parts", rule=rule).collect():
        text, parts = rows[r.doc_id][1:3] if r.doc_id < 90 else {90: ("", [(0, 3)]), 91: ("abc def", []), 92: ("abc", [(0, 0), (1, 1)])}[r.doc_id]
        counts, crossing, outside = brute_counts(text or "", parts, rule)
        assert [s.tokens for s in r.counted.sections] == pytest.approx(counts)
        assert [s.crossing for s in r.counted.sections] == crossing
        assert r.counted.outside == outside and r.counted.tokens == len(tik().encode_ordinary(text or ""))


def test_lines_are_the_default_sections(spark):
    texts = ["a b\n\nc", "", None, "x\n", "\n", "  \n  y"]
    for r in token_counts.attribute(frame(spark, texts), PATH).collect():
        lines = re.findall(r"[^\n]*\n|[^\n]+$", texts[r.doc_id] or "")
        assert [s.end - s.start for s in r.counted.sections] == [len(x) for x in lines]
        assert sum(s.tokens for s in r.counted.sections) == r.counted.tokens and r.counted.outside == 0


def test_unsorted_sections_and_unknown_rules_raise(spark):
    docs = spark.createDataFrame([(1, "abc", [(2, 3), (0, 1)])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    with pytest.raises(Exception, match="sorted"):
        token_counts.attribute(docs, PATH, sections="parts").collect()
    with pytest.raises(ValueError):
        token_counts.attribute(docs, PATH, rule="none")


# ------------------------------------------------------------------ license scan

def test_licenses_are_found_with_edits_and_spans(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    texts = [None, "", "nothing here", "é " * 30 + apache + " more", apache.upper().replace(" ", "\n"),
             "x Licensed under the Apache Public License, Version 2.0 y " * 2, "the apache software license and version two", "Released under the MIT License"]
    got = license_scan.scan(frame(spark, texts)).collect()
    found = sorted((r.doc_id, r.license, r.matched_words) for r in got)
    assert found == [(3, "Apache-2.0 statement", 8), (4, "Apache-2.0 statement", 8), (5, "Apache-2.0 statement", 8), (5, "Apache-2.0 statement", 8), (7, "MIT statement", 5)]
    three = next(r for r in got if r.doc_id == 3)
    assert texts[3][three.start:three.end] == apache.rstrip(".") and three.coverage == 1.0
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_every_kind_of_license_line_in_the_documents_is_found(spark):
    lines = {"All rights reserved.": "All rights reserved statement", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0 statement",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0 statement",
             "Released under the MIT License.": "MIT statement", "Licensed under the Apache License, Version 2.0.": "Apache-2.0 statement"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = {(r.doc_id, lines[r.text.split("\n")[-1]]) for r in docs.collect() if (r.text or "").split("\n")[-1] in lines}
    assert {name for _, name in planted} == set(lines.values())
    assert planted <= {(r.doc_id, r.license) for r in license_scan.scan(docs).collect()}
    spdx = license_scan.scan(frame(spark, ["# SPDX-License-Identifier: Apache-2.0", "// spdx-license-identifier: MIT", "all rights of way reserved"]))
    assert sorted((r.doc_id, r.license) for r in spdx.collect()) == [(0, "SPDX identifier line"), (1, "SPDX identifier line")]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_alignment_in_a_full_band_is_the_longest_common_subsequence():
    import numpy as np
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 12))
        score, first, last = license_scan.align(a, b, -len(a), len(b))
        assert score == longest_common(a.tolist(), b.tolist())
        if score:
            assert longest_common(a.tolist(), b[first:last + 1].tolist()) == score and first >= 0


def test_every_long_shared_run_is_a_candidate():
    s = license_scan.Settings()
    words = [f"t{i}" for i in range(60)]
    index = license_scan.Index([("t", " ".join(words))], s)
    import pyarrow as pa
    from casewright.llm import kernels as K
    for at in range(60 - s.window - s.gram + 1):
        part = "zz " + " ".join(words[at:at + s.window + s.gram - 1]) + " qq"
        data, off = K.text_bytes(pa.array([part]))
        assert list(index.anchors(*K.word_hashes(data, off, license_scan.SEPARATORS)))


# ------------------------------------------------------------------ decontamination

ITEM = "Yesterday the baker Alice sold 12 loaves for 3 dollars each while Alice kept 5 loaves at home for dinner"


def contaminated(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}


def test_templates_catch_other_numbers_and_names_if_they_are_consistent(spark):
    renamed = ITEM.replace("Alice", "Robert").replace("12", "40").replace("3 dollars", "7 cents").replace("5 loaves", "9 loaves")
    torn = ITEM.replace("baker Alice", "baker Robert").replace("while Alice", "while Maria")
    same_value = ITEM.replace("12", "5")  # two slots of the item with one value in the document
    texts = ["Intro words. " + ITEM + " Outro.", "Intro. " + renamed, "x " + torn, "y " + same_value, "The baker sold bread", None, "",
             ITEM.upper(), "first half only: " + ITEM[:45]]
    got = contaminated(spark, texts)
    assert {d for d, _ in got} == {0, 1, 7}
    assert not got[0, 1].reparameterised and got[1, 1].reparameterised and got[0, 1].coverage == 1.0


def test_a_conflict_voids_only_its_windows(spark):
    hours = "The slow ferry needs 1 hour to cross the wide bay and then it waits for 3 hours in the old harbour before it sails back"
    boxes = "A farmer packs 10 boxes with 10 eggs each and drives them to the market where half of all the eggs are sold"
    other = boxes.replace("10 boxes", "8 boxes")
    long = other + " before noon while the rest goes to a small shop near the river"
    items = [(1, hours), (2, boxes), (3, other), (4, long)]
    six = lambda t: t.replace("8 boxes with 10", "6 boxes with 6")
    texts = [hours.replace("1 hour", "2 hours").replace("3 hours", "4 hours"), boxes.replace("10 eggs", "12 eggs"), six(other), six(long)]
    got = contaminated(spark, texts, items)
    assert got[0, 1].coverage == 1.0 and got[0, 1].reparameterised      # hour and hours are one unit
    assert got[1, 2].coverage == 1.0 and got[1, 2].reparameterised      # equal numbers, different quantities
    assert got[3, 4].n_windows - got[3, 4].matched == 4                 # only the windows of one slot are lost
    assert (2, 3) not in got                                            # two values made one: short items stay below the coverage


def test_joined_numbers_number_words_units_and_opening_names_are_slots(spark):
    crate = "A crate of 12kg stands on the old cart. Anna pulls it for 5 minutes up the steep hill road"
    letter = "Martin writes a 3-page letter to 2 friends and sends it by the slow night train"
    speed = "the truck drives at 60 mph for three hours on the 5th day and then rests in the old yard"
    items = [(1, crate), (2, letter), (3, speed)]
    texts = ["the cart and a crate. " + crate.replace("12kg", "15kg").replace("Anna", "Lisa").replace("5 min", "7 min"),
             "he writes. 4x4 cars. " + letter.replace("Martin", "Peter").replace("3-page", "5-page").replace("2 fr", "4 fr"),
             speed.replace("60 mph", "80 kmh").replace("three", "seven").replace("5th", "2nd"),
             letter.replace("writes", "reads").replace("friends", "dogs")]
    got = contaminated(spark, texts, items)
    assert set(got) == {(0, 1), (1, 2), (2, 3)}
    assert all(r.coverage == 1.0 and r.reparameterised for r in got.values())
    assert (got[1, 2].first_token, got[1, 2].last_token) == (4, 4 + len(letter.split()) - 1)   # tokens cut at white space


def test_short_empty_and_equal_items(spark):
    items = [(1, "alpha beta"), (2, None), (3, " "), (4, "alpha beta"), (5, "1 2 3 4 5 6")]
    got = contaminated(spark, ["say Alpha, beta!", "alpha gamma", "1 2 3 4 5 6"], items)
    assert set(got) == {(0, 1), (0, 4)}
    assert contaminated(spark, []) == {}


def test_rows_without_an_id_and_keep(spark):
    docs = spark.createDataFrame([(None, ITEM, "a"), (1, ITEM, "b"), (2, "clean", "c"), (2, "clean", "c")], "doc_id long, text string, n string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontaminate.keep(docs, bench)
    assert kept.columns == docs.columns and sorted(r.n for r in kept.collect()) == ["a", "c", "c"]


def test_a_scan_makes_the_tokens_of_a_text_once(spark):
    docs = spark.createDataFrame([(1, "a 12kg  bag"), (2, None), (3, " "), (4, "x\x01y"), (None, "no id")], "doc_id long, text string")
    rows = decontaminate._tokens(docs, "doc_id")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    found = sorted((r.doc_id, r.at, r.token) for r in rows.collect())
    assert found == [(1, 0, "a"), (1, 1, "12"), (1, 2, "\x01kg"), (1, 3, "bag"), (4, 0, "x"), (4, 1, "y")]


# ------------------------------------------------------------------ archives

def test_archives_round_trip(spark):
    big, two = "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "b" * 999
    pages = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, two), (4, "http://d", two), (5, "http://e", None), (6, "http://f", ""),
             (7, "http://g", "c" * 70_000), (None, "http://h", big), (2, "http://b2", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).withColumn("payload", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    rows = warc.round_trip(df).collect()
    assert len(rows) == len(pages)
    for r in rows:
        html = next(h for p, u, h in pages if p == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if r.page_id == 1 else ("response", None))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html.encode()


def test_normalised_archives_have_a_member_for_each_record(spark):
    prepare(spark)
    folder = shared_folder(spark, "warc-test")
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * i) for i in range(40)], "page_id long, url string, html string").repartition(2)
    warc.write_monolithic(pages, f"{folder}/mono")
    sums = warc.normalise(spark, f"{folder}/mono", f"{folder}/out").collect()
    assert sum(r.records for r in sums) == 40
    local = re.sub("^file:", "", folder)
    for r in sums:
        with open(f"{local}/out/{r.archive}", "rb") as f, open(f"{local}/out/{r.archive}.idx") as index:
            data, entries = f.read(), [json.loads(x) for x in index]
        assert [e["offset"] for e in entries] == [sum(e["length"] for e in entries[:k]) for k in range(len(entries))]
        parts = [gzip.decompress(data[e["offset"]:e["offset"] + e["length"]]) for e in entries]
        assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts) and b"".join(parts) == gzip.decompress(data)


def test_empty_pages_and_torn_streams(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(ValueError):
        list(warc.split_records([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"]))
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for size in (1, 7, 1000):
        data = record * 3
        assert list(warc.split_records(data[i:i + size] for i in range(0, len(data), size))) == [record] * 3


def test_round_trip_in_one_worker_equals_encoding_and_decoding_apart(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "Hello  wörld\n"), (2, None), (3, ""), (4, "a" * 5000), (1, "Hello  wörld\n")], "doc_id long, text string").coalesce(1)
    apart = bpe.decode(bpe.encode(docs, path), path).select("doc_id", "text", "ids", "decoded")
    both = bpe.round_trip(docs, path)
    assert both.columns == apart.columns and sorted(map(repr, both.collect())) == sorted(map(repr, apart.collect()))
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_hits_leave_their_text_in_the_scan(spark):
    """A row for each hit must not hold the text's tokens: a long text with many hits would take their product."""
    item = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, f"A 12kg crate of 3-page letters . {item} near 5km of road")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = decontaminate.hits(docs, *decontaminate.index(docs, bench, decontaminate.Settings()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode(array(")
    assert "toks#" not in above and "lambda" not in below.splitlines()[0]
    assert not re.search(r"Filter .*lower\(trim\(token#", below[:below.index("Generate posexplode(")])      # no core for every token
    rows = {(r.item_at, r.first, r.last) for r in found.collect()}
    assert rows == {(i, 7 + i, 11 + i) for i in range(5)}     # joints before and after do not count
