"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, extra columns
with clashing names, and empty tables; results against brute force."""

import hashlib
import math
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavemark.llm import bpe, fingerprints, labelled, lm_scoring, near_dedup, packing, quality_rules, sharding, token_files, toxicity, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, shard string, score string, ids string, kept string, block string, range_id string"
LONG = "over the hills and far away they went singing all day long " * 400
TEXTS = [
    "The quick brown fox jumps over the lazy dog.", None, "", "   ", "a", LONG, LONG, "naïve café — “quotes” …\n\n x \n y", "日本語のテキスト 123", "don't stop  believing   now", "<|endoftext|> inside",
    "repeat " * 60, "The quick brown fox jumps over the lazy dog.", "tab\tand\x0bother\x0cspaces\r\n here", "x" * 3000, "\x1c odd \x85 spaces \xa0 here",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *["z"] * 7) for i, t in enumerate(TEXTS)] + [(None, "null id", *["z"] * 7), (3, "   ", *["z"] * 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, F.length("text"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, none):
    tok = Tokenizer.from_file(BYTE)
    rows = packing.pack_documents(docs, BYTE, capacity=64, block_ids=2000).collect()
    want = Counter()
    for t in [*TEXTS, "null id", "   "]:
        want[np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()] += 1
    by_doc = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 64
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    got = Counter()
    for (doc, n), parts in by_doc.items():
        whole = b"".join(p for _, p in sorted(parts))
        copies = len(whole) // (4 * n)
        got[whole[: 4 * n] if copies == 1 else whole[: 4 * n]] += copies
        assert doc == 3 or copies == 1
    assert got == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none, BYTE).collect() == []


@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_minimum_bin_slack(lengths):
    counts = dict(Counter(lengths))
    chosen = packing.fill(counts, 40)
    assert all(c <= counts[n] for n, c in chosen)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= 40}
    assert sum(n * c for n, c in chosen) == max(sums)
    sequence, offset = packing.place(np.array(lengths), 40)
    used = Counter()
    for s, n in zip(sequence, lengths, strict=True):
        used[s] += n
    assert max(used.values()) <= 40 and len(offset) == len(lengths)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_sharding(docs, none, shards):
    rows = sharding.shuffle_to_shards(docs, shards, seed=1, rows_per_bin=2).collect()
    assert Counter(r["text"] for r in rows) == Counter([*TEXTS, "null id", "   "])
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert sharding.shuffle_to_shards(none, shards).collect() == []


def test_sharding_is_uniform():
    before, sizes = np.array([0, 3, 4, 10]), np.array([4, 3, 3])
    seen = Counter(tuple(sharding.matrix_row(before, sizes, 0, seed)) for seed in range(4000))
    for row, n in seen.items():
        chance = math.prod(math.comb(int(s), int(k)) for s, k in zip(sizes, row, strict=True)) / math.comb(10, 3)
        assert abs(n / 4000 - chance) < 5 * math.sqrt(chance / 4000) + 0.002
    total = sum(sharding.matrix_row(before, sizes, p, 9) for p in range(3))
    assert total.tolist() == sizes.tolist()
    big = [sharding._two_way(np.random.default_rng(i), 3 * 10**9, 10**9, 10**6) for i in range(300)]
    assert abs(np.mean(big) - 750_000) < 5 * 433 / math.sqrt(300) and 300 < np.std(big) < 570


def test_bpe(docs, none):
    tok = Tokenizer.from_file(WORD)
    rows = bpe.decode_documents(bpe.encode_documents(docs, WORD), WORD).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "null id" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        ids = tok.encode(text or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(none, WORD).collect() == []


@given(st.lists(st.text(alphabet="abehilnoprst", min_size=1, max_size=14), min_size=1, max_size=40))
@settings(max_examples=50, deadline=None)
def test_speculation_is_exact(words):
    encoder = bpe.text_encoder(WORD)
    want = Tokenizer.from_file(WORD).encode_batch([words], is_pretokenized=True, add_special_tokens=False)[0].ids
    assert [t for row in encoder._bpe.encode_words(words) for t in row] == want


def naive_phrases(text):
    known, phrase, ends = set(), "", []
    for i, c in enumerate(text):
        phrase += c
        if phrase not in known:
            known.add(phrase)
            ends.append(i + 1)
            phrase = ""
    return ends


@given(st.text(alphabet="ab ", max_size=80), st.text(alphabet="ab ", max_size=80))
@settings(max_examples=80, deadline=None)
def test_phrases(text, other):
    half = len(text) - len(text) // 2
    parsed = fingerprints.parse(text, half)
    assert parsed.ends == naive_phrases(text)
    edited = text[:half] + other[: len(text) - half]
    ends = parsed.ends[: parsed.settled]
    known = {text[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    assert fingerprints.parse(edited, before=(ends, known)).ends == naive_phrases(edited)


def test_fingerprints(docs, none):
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_edits(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    for i, text in enumerate(TEXTS):
        text, after = text or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = rows[i]
        assert (r["edited"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (edited, len(text), fingerprints.fingerprint(text), fingerprints.fingerprint(edited))
        assert r["near_next"] == fingerprints.likeness(fingerprints.from_text(r["fingerprint"]), fingerprints.from_text(fingerprints.fingerprint(after)))
    assert rows[5]["near_next"] == 1.0
    assert fingerprints.compare_with_edits(docs).count() == len(TEXTS) + 2
    assert fingerprints.compare_with_edits(none).collect() == []
    assert fingerprints.fingerprint_documents(docs).count() == len(TEXTS) + 2


def test_toxicity(spark, none):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(900):
        body = list(rng.choice(words, 40))
        insult, group = i % 3 == 0, i % 2 == 0
        body += ["insult"] * insult + ["they"] * group
        rows.append((i, " ".join(body), int(insult and group), "x"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    machine = toxicity.fit_toxicity(frame, frame.select("doc_id", "toxic"))
    got = toxicity.score_toxicity(frame.drop("toxic"), machine).join(frame.select("doc_id", "toxic"), "doc_id").where(labelled.held_out(F.col("doc_id"))).collect()
    assert len(got) > 150 and np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.97  # an interaction, not a word
    assert toxicity.score_toxicity(none.select("doc_id", "text"), machine).collect() == []
    odd = toxicity.score_toxicity(spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string"), machine).collect()
    assert len({r["score"] for r in odd}) == 1 and len(odd) == 3
    nothing = toxicity.fit_toxicity(frame, frame.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert toxicity.score_toxicity(frame, nothing).where("predicted = 1").isEmpty()


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return group, sets


def test_near_duplicates(spark, docs, none):
    rng = np.random.default_rng(5)
    texts = {}
    for family in range(6):
        base = [f"f{family}x{k}" for k in range(90)]
        for copy in range(25):
            own = list(base)
            for _ in range(int(rng.integers(0, 6))):
                own[int(rng.integers(90))] = f"e{rng.integers(8)}"
            texts[len(texts)] = " ".join(own)
    texts |= {len(texts): "a b", len(texts) + 1: "A  b", len(texts) + 2: "", len(texts) + 3: None, len(texts) + 4: "c"}
    frame = spark.createDataFrame([(i, t, "q") for i, t in texts.items()], "doc_id long, text string, component_id string")
    want, sets = brute_components(texts, 3, 85)
    for r in near_dedup.near_duplicates(frame, width=3, percent=85).collect():
        assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
    assert near_dedup.near_duplicates(docs).count() == len(TEXTS) + 2
    assert near_dedup.near_duplicates(none).collect() == []


@pytest.mark.parametrize("percent", [62, 70, 80, 85, 90, 100])
def test_reach_of_near_duplicates(percent):
    far, miss = near_dedup.reach(percent), 1 - percent / 100
    beyond = sum(math.comb(64, k) * miss**k * (1 - miss) ** (64 - k) for k in range(far + 1, 65))
    assert beyond <= 1e-5 and far < 2 * near_dedup.chunks_for(far)
    assert 64 // near_dedup.chunks_for(far) >= 3  # a key holds two symbols at least


def test_links_at_the_far_end(spark):
    """Pairs at exactly 0.8 (80 of 100 shingles), whose signatures differ in 24 symbols or more."""
    rng, texts, tries = np.random.default_rng(8), {}, 0
    while len(texts) < 4:
        tries += 1
        base = [f"w{tries}x{k}" for k in range(94)]
        other = list(base)
        for k in rng.choice(17, 2, replace=False):
            other[int(k) * 5 + 4] = "edited"
        rows = [near_dedup.shingle_sets([" ".join(t)], 5) for t in (base, other)]
        apart = (near_dedup.signatures(*rows[0]) != near_dedup.signatures(*rows[1])).sum()
        if 24 <= apart <= near_dedup.reach(80):
            texts |= {len(texts): " ".join(base), len(texts) + 1: " ".join(other)}
    want, _ = brute_components(texts, 5, 80)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame, width=5, percent=80).collect()}
    assert got == want and len(set(want.values())) == len(texts) // 2
    with pytest.raises(ValueError, match="percent"):
        near_dedup.near_duplicates(frame, percent=50)


def test_text_counts(docs, none):
    rows = {r["doc_id"]: r for r in quality_rules.with_counts(docs).collect() if r["doc_id"] is not None}
    for i, t in enumerate(TEXTS):
        words = (t or "").encode().split()
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        repeated = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), sum(len(w.decode()) for w in words), len(repeated), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum((t or "").count(c) for c in "#*$%&|<>")
    assert quality_rules.judge_quality(none, []).collect() == []


def test_decision_list():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality_rules.STATISTICS)))
    bad = (x[:, 1] > 0.8) | ((x[:, 3] > 0.7) & (x[:, 0] <= 0.4))
    rules = quality_rules.learn_rules(x, bad)
    held = np.zeros(len(x), bool)
    for rule in rules:
        held |= quality_rules.covered(rule, x)
    assert (held == bad).mean() > 0.98
    assert quality_rules.learn_rules(x, np.zeros(len(x), bool)) == []


def test_token_files(spark, docs, none, tmp_path):
    tok = Tokenizer.from_file(BYTE)
    frame = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    manifest = token_files.write_token_files(frame, BYTE, str(tmp_path), sequence_length=16, rows_per_file=5, batch_rows=4)
    rows = token_files.with_global_starts(token_files.read_token_files(manifest), manifest).orderBy("doc_id").collect()
    at = 0
    for i, (r, t) in enumerate(zip(rows, TEXTS, strict=True)):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (i, at, len(ids), ids.tobytes())
        at += len(ids)
    first = manifest.orderBy("range_id").first()
    reader, index = token_files.open_token_file(first["folder"], first["name"])
    ids, mask = token_files.sequence(reader, 0)
    assert len(ids) == 16 and token_files.unpacked_mask(mask, 16).sum() == min(16, first["n_tokens"]) and ids[0] == np.frombuffer(rows[0]["ids"], "<u4")[0] and index.num_rows == first["n_docs"]
    assert token_files.write_token_files(none, BYTE, str(tmp_path / "none")).collect() == []
    assert token_files.write_token_files(docs, BYTE, str(tmp_path / "all")).agg(F.sum("n_docs")).first()[0] == len(TEXTS) + 2


def test_token_manifest_is_written_by_one_task_for_many_files(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"text {i}") for i in range(24)], "doc_id long, text string").repartition(3)
    manifest = token_files.write_token_files(frame, BYTE, str(tmp_path), rows_per_file=2)
    assert [r["range_id"] for r in manifest.orderBy("range_id").collect()] == list(range(12))
    assert manifest.agg(F.sum("n_docs")).first()[0] == 24 and len(manifest.inputFiles()) == 1


def test_warc(spark, tmp_path):
    big = "<p>" + "same payload " * 20
    pages = {5: big, 2: big, 9: big, 1: "short", 3: "short", 4: None, 6: "", 7: "ünïcode\r\n\r\nWARC/1.1\r\n" * 30}
    frame = spark.createDataFrame([(i, f"http://h/{i}\nx", h, "c") for i, h in pages.items()] + [(2, "http://h/2", big, "c")], "page_id long, url string, html string, type string").repartition(3)
    captures = warc.assemble(warc.read_records(warc.write_archives(frame, str(tmp_path))))
    nested = captures.collect()
    assert len(nested) == 9 and all(r["request"] and r["metadata"] and r["response"] for r in nested)
    rows = warc.captured_pages(captures).collect()
    assert Counter(r["page_id"] for r in rows) == Counter([*pages, 2])
    for r in rows:
        payload = (pages[r["page_id"]] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if r["page_id"] in (5, 9) else ("response", None))
    empty = warc.write_archives(frame.where("page_id < 0"), str(tmp_path / "none"))
    assert warc.captured_pages(warc.assemble(warc.read_records(empty))).collect() == []


def test_lm_scores(docs, none):
    rows = lm_scoring.score_documents(docs, block_chars=5000).collect()
    words = [(t or "").lower().encode().split() for t in [*TEXTS, "null id", "   "]]
    counts = [Counter(tuple(w[i - k : i + 1]) for w in words for i in range(k, len(w))) for k in range(3)]
    size = sum(map(len, words))

    def score(w):
        total = 0.0
        for i in range(len(w)):
            for k in range(min(i, 2), -1, -1):
                own = tuple(w[i - k : i + 1])
                if k == 0:
                    total += math.log(counts[0][own] / size)
                elif counts[k][own] >= 2:
                    total += math.log(counts[k][own] / counts[k - 1][own[:-1]])
                    break
                else:
                    total += math.log(0.4)
        return total

    assert len(rows) == len(words)
    for r in rows:
        w = ("null id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or "").lower().encode().split()
        assert r["n_words"] == len(w) and abs(r["log_score"] - score(w)) < 1e-6
    assert lm_scoring.score_documents(none).collect() == []


def test_ngrams_keep_all_hash_bits(monkeypatch):
    """Hashes that differ in their last bit only, or that orders share, are different n-grams."""
    hashes = [np.array([4, 5, 1 << 63], np.uint64), np.array([5, 4], np.uint64), np.array([4], np.uint64)]
    monkeypatch.setattr(lm_scoring, "ngram_hashes", lambda words, sizes: ((k + 1, np.arange(k, 3), h) for k, h in enumerate(hashes)))
    assert [lm_scoring.bucket_bits(n, 2_000_000) for n in (0, 10**9, 10**15)] == [2, 9, 29]
    _, buckets, keys, counts, place = lm_scoring.distinct_ngrams(np.zeros(3, np.uint64), np.array([3]), 2)
    assert buckets.tolist() == [0, 0, 0, 0, 0, 2] and counts.tolist() == [1] * 6
    assert len(set(keys[:5].tolist())) == 5 and keys[:5].tolist() == sorted(keys[:5].tolist())
    assert place.tolist() == [0, 1, 5, 3, 2, 4]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(300):
        text = " ".join(f"word{rng.integers(4000)}" for _ in range(60))
        toxic, bad = int(i % 10 == 0), int(i % 7 == 0)
        text += " horrid" if toxic else ""
        text = " ".join(f"{w}###" for w in text.split()) if bad and not toxic else text
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if bad and not toxic else 1, toxic))
    rows += [(300 + i, rows[i][1], "en", "s", rows[i][4]) for i in (1, 2, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, left, str(tmp_path)).write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        assert left.columns == docs.columns
    clean = {i for i in range(300) if i % 10 and i % 7}
    assert {r["doc_id"] for r in left.collect()} == clean
    packed = corpus_pipeline.run(spark, str(tmp_path))
    tok = Tokenizer.from_file(BYTE)
    sums = {r["doc_id"]: r for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum(F.crc32("ids")).alias("c")).collect()}
    assert set(sums) == clean
    for i in clean:
        assert sums[i]["n"] == len(tok.encode(rows[i][1], add_special_tokens=False).ids) + 1


def test_pipeline_decides_by_row(spark, tmp_path):
    """Null ids, repeated rows, an id of two texts, columns that clash, and an empty table."""
    import corpus_pipeline

    rng = np.random.default_rng(7)
    text = [" ".join(f"word{rng.integers(4000)}" for _ in range(60)) for _ in range(4)]
    near = text[0].rsplit(" ", 1)[0] + " other"
    rows = [(1, text[0]), (1, text[0]), (None, text[0]), (2, near), (2, text[1]), (None, text[2]), (None, text[2]), (5, None), (6, ""), (7, text[3])]
    names = ("kept", "score", "predicted", "n_words", "n_lines", "_text", "row", "component_id", "ids")
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)
    spark.createDataFrame([(i, t, *[f"{k}"] * len(names)) for k, (i, t) in enumerate(rows)], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, left, str(tmp_path)).write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
    got = [tuple(r) for r in left.collect()]
    assert Counter((r[0], r[1]) for r in got) == Counter([(1, text[0]), (2, text[1]), (None, text[2]), (7, text[3])])
    assert all(len({*r[2:]}) == 1 and rows[int(r[2])] == (r[0], r[1]) for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 4
    (tmp_path / "none").mkdir()
    for name in ("documents", "labels"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
