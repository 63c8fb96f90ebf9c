"""The operators' results against slow, plain versions, and the queries' own columns."""

import hashlib
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_small import brute_components, naive_phrases
from wavemark.llm import bpe, fingerprints, labelled, lm_scoring, near_dedup, ordering, packing, quality_rules, queries, sharding, token_files, tokens, toxicity, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = st.lists(st.one_of(st.sampled_from([*"ab's., 　\xa0\x85\t\n", "  ", "<|endoftext|>"]), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join)

CONTRACTS = {
    "op1_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op10_lm_scoring": "doc_id bigint, n_words bigint, log_score double, mean_log_score double",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", CONTRACTS)
def test_query(spark, texts, name):
    found = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) == CONTRACTS[name]
    rows = [r.asDict() for r in found.collect()]
    if name == "op9_warc":
        assert len({r["page_id"] for r in rows}) == len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
        return
    assert {r["doc_id"] for r in rows} == set(texts) and (name == "op1_packing" or len(rows) == len(texts))
    if name in ("op1_packing", "op8_token_files"):
        tok, at = Tokenizer.from_file(BYTE), 0
        for doc in sorted(texts):
            ids = np.array([*tok.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
            own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
            if name == "op1_packing":
                assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and sum(r["length"] for r in own) == own[0]["doc_tokens"] == len(ids)
                assert all(r["ids_crc32"] == _crc(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
            else:
                assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in own] == [(at, len(ids), _crc(ids.tobytes()))]
            at += len(ids)
    elif name == "op2_sharding":
        shards = Counter(r["shard"] for r in rows)
        assert max(shards.values()) - min(shards.get(s, 0) for s in range(8)) <= 1
        for s, n in shards.items():
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
        assert all((r["size"], r["text_crc32"]) == (len((texts[r["doc_id"]] or "").encode()) + 1, _crc((texts[r["doc_id"]] or "").encode())) for r in rows)
    elif name == "op3_bpe":
        tok = Tokenizer.from_file(WORD)
        for r in rows:
            ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), _sha(" ".join(map(str, ids))), _sha(tok.decode(ids, skip_special_tokens=False)))
    elif name == "op4_fingerprints":
        order = sorted(texts)
        for r in rows:
            text, after = texts[r["doc_id"]] or "", texts[order[(order.index(r["doc_id"]) + 1) % len(order)]] or ""
            assert r["n_chars"] == len(text) and r["edited_sha256"] == _sha(text[: len(text) - len(text) // 2] + after[: len(text) // 2])
    elif name == "op5_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (_crc(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    elif name == "op6_near_dedup":
        want, sets = brute_components(texts, 3, 85)
        assert all((r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]), want[r["doc_id"]] == r["doc_id"]) for r in rows)
    elif name == "op7_quality_rules":
        for r in rows:
            failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
            assert r["base_failed"] == failed and not (failed and r["kept"])


def _crc(data):
    import zlib

    return zlib.crc32(data)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@given(st.lists(ODD, max_size=12))
@settings(max_examples=150, deadline=None)
def test_encoders_equal_the_library(some):
    for path, encoder in ((BYTE, tokens.byte_encoder(BYTE)), (WORD, bpe.text_encoder(WORD))):
        values, sizes = encoder.encode(some)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)] if some else []
        assert sizes.tolist() == [*map(len, want)] and values.tolist() == [t for r in want for t in r]


def test_encoders_on_long_and_many_words():
    some = ["x" * 3000, "日本語" * 3000, "Δοκιμή " * 300, "ab" * 5000 + " end", None, "", " ", "w" * 80 + " b"]
    for path, make in ((BYTE, tokens.ByteEncoder), (WORD, bpe.TextEncoder)):
        tok, encoder = Tokenizer.from_file(path), make(path, 3)  # a memo that is forgotten all the time
        for _ in range(2):
            values, sizes = encoder.encode([*some, "one two three four five"])
            want = [tok.encode(t or "", add_special_tokens=False).ids for t in [*some, "one two three four five"]]
            assert sizes.tolist() == [*map(len, want)] and values.tolist() == [t for r in want for t in r]


def test_a_worker_keeps_little_memory_of_texts():
    """What a process holds more than before, in MB, once it has encoded 1.2 million new words."""
    said = """
import re, sys
import numpy, pandas, pyarrow as pa, tokenizers
from wavemark.llm import tokens
def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
pa.array(["a"])
before, encoder = held(), tokens.byte_encoder(sys.argv[1])
for k in range(4):
    batch = pa.array([" ".join(f"{i * 2654435761 % 4294967296:x}" for i in range(a, a + 100)) for a in range(k * 300_000, (k + 1) * 300_000, 100)])
    for _, _, texts in tokens.text_slices(batch):
        encoder.encode(texts)
print(held() - before)
"""
    root = str(Path(tokens.__file__).parents[2])
    ran = subprocess.run([sys.executable, "-c", said, BYTE], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}, check=True)
    assert float(ran.stdout) < 90


def test_bitmap_comes_in_one_job(spark):
    ids = spark.range(0, 3000, 7).select(F.col("id").alias("doc_id"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.sparkContext.setJobGroup("bitmap", "bitmap")
    try:
        among = near_dedup._may_be_among(ids, F.col("doc_id"))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(jobs) <= 3
    got = {r.doc_id for r in spark.range(3000).select(F.col("id").alias("doc_id")).where(among).collect()}
    assert {*range(0, 3000, 7)} <= got and len(got) < 500


@given(st.text(alphabet="abehilnoprst", min_size=65, max_size=150))
@settings(max_examples=50, deadline=None)
def test_long_words_merge_as_short_ones(word):
    machine = bpe.text_encoder(WORD)._bpe
    want = Tokenizer.from_file(WORD).encode([word], is_pretokenized=True, add_special_tokens=False).ids
    assert machine.merge(word) == want


def plain_hashes(text):
    """The 32-bit hash of each phrase, by its definition: a polynomial in the mixed code points."""
    whole, out, start = (1 << 64) - 1, set(), 0
    base = int(fingerprints._BASE)
    for end in naive_phrases(text):
        total = sum(int(fingerprints.mix(np.array([ord(c) + 1], np.uint64))[0]) * pow(base, k, 1 << 64) for k, c in enumerate(text[start:end])) & whole
        out.add(int(fingerprints.mix(np.array([total], np.uint64))[0]) >> 32)
        start = end
    return out


def plain_likeness(a, b, size=fingerprints.SIZE):
    if not a or not b:
        return float(a == b)
    union = sorted(a | b)[:size]
    return sum(h in a and h in b for h in union) / len(union)


def test_fingerprints(spark):
    words = np.random.default_rng(4)
    long = " ".join(f"w{words.integers(300)}" for _ in range(500))
    some = ["", "a", "abcabcabcabd é日", long, long[:-40] + " another ending", None, "abcabcabcabd é日", "b" * 50]
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_edits(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(3)).collect()}
    for i, text in enumerate(some):
        text, after = text or "", some[(i + 1) % len(some)] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, changed, theirs = ({*sorted(plain_hashes(t))[: fingerprints.SIZE]} for t in (text, edited, after))
        assert rows[i]["edited"] == edited
        assert {*fingerprints.from_text(rows[i]["fingerprint"]).tolist()} == own and {*fingerprints.from_text(rows[i]["edited_fingerprint"]).tolist()} == changed
        assert rows[i]["near_edited"] == pytest.approx(plain_likeness(own, changed)) and rows[i]["near_next"] == pytest.approx(plain_likeness(own, theirs))
    assert rows[2]["fingerprint"] == rows[6]["fingerprint"]


def test_machine_adds_every_pair():
    rng = np.random.default_rng(0)
    machine = toxicity.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    for own in ([], [2], [0, 3, 5], list(range(6))):
        total = 0.3 + sum(machine.weights[i] for i in own) + sum(float(machine.vectors[i] @ machine.vectors[j]) for i in own for j in own if i < j)
        assert machine.score(np.array(own, int)) == pytest.approx(1 / (1 + np.exp(-total)))


def test_machine_gradient():
    rng = np.random.default_rng(1)
    x, y, importance = (rng.random((30, 5)) < 0.5).astype(float), (rng.random(30) < 0.4).astype(float), rng.random(30)
    params = [np.array([0.2]), rng.normal(size=5), rng.normal(size=(5, 3))]

    def loss(p):
        total = np.array([p[0][0] + sum(p[1][i] for i in np.flatnonzero(r)) + sum(p[2][i] @ p[2][j] for i in np.flatnonzero(r) for j in np.flatnonzero(r) if i < j) for r in x])
        return float((importance * (np.logaddexp(0, total) - y * total)).sum() + 0.01 / 2 * sum((q**2).sum() for q in p[1:]))

    for k, g in enumerate(toxicity.gradient(x, y, importance, params, 0.01)):
        for at in np.ndindex(g.shape):
            moved = [[q.copy() for q in params] for _ in range(2)]
            moved[0][k][at] += 1e-6
            moved[1][k][at] -= 1e-6
            assert g[at] == pytest.approx((loss(moved[0]) - loss(moved[1])) / 2e-6, abs=1e-5)


def test_rules_decide_as_their_conditions_say(spark):
    rng = np.random.default_rng(6)
    made = [" ".join(rng.choice(["word", "WORD", "#x", "again again", "a!", "line\nline"], int(rng.integers(1, 60)))) for _ in range(80)] + ["", None]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    condition = quality_rules.Condition
    rules = [(condition("symbols_per_word", True, 0.15), condition("n_words", False, 30.0)), (condition("upper_share", True, 0.3),), (condition("echo_share", False, 0.0), condition("dup_line_share", True, 0.1))]
    rows = quality_rules.judge_quality(frame, rules).withColumn("s", F.array(*map(quality_rules.statistic, quality_rules.STATISTICS))).collect()
    x = np.array([r["s"] for r in rows])
    bad = np.logical_or.reduce([quality_rules.covered(rule, x) for rule in rules])
    assert 5 < bad.sum() < len(rows) - 5
    for r, hit in zip(rows, bad, strict=True):
        own = (made[r["doc_id"]] or "").split()
        ratio = lambda a, b: a / b if b else 0.0
        want = dict(zip(quality_rules.STATISTICS, r["s"], strict=True))
        assert want["n_words"] == len(own) and want["symbols_per_word"] == ratio(sum(c in "#*$%&|<>" for c in "".join(own)), len(own)) and want["upper_share"] == ratio(sum(c.isupper() for c in "".join(own)), len("".join(own)))
        assert want["echo_share"] == ratio(sum(a == b for a, b in zip(own, own[1:], strict=False)), len(own))
        by_hand = (want["symbols_per_word"] > 0.15 and want["n_words"] <= 30) or want["upper_share"] > 0.3 or (want["echo_share"] <= 0 and want["dup_line_share"] > 0.1)
        failed = len(own) < 10 or 100 * r["n_repeat_words"] > 20 * len(own)
        assert hit == by_hand and r["base_failed"] == failed and r["kept"] == (not failed and not by_hand)


CLASHING = "doc_id long, text string, kept string, score string, predicted string, n_words string, n_lines string, _text string, row string, base_failed string, `a.b` string, row_number string, Key string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, *[f"{k}{n}" for n in range(11)]) for k, (i, t) in enumerate(rows)], CLASHING)


def test_columns_of_any_name_come_out_unchanged(spark):
    text = " ".join(f"word{i}" for i in range(30))
    frame = clashing(spark, [(1, text), (1, text), (None, text), (2, ""), (None, None)])
    want = Counter(map(tuple, frame.collect()))
    machine = toxicity.Machine(np.zeros(0, np.int64), -3.0, np.zeros(0), np.zeros((0, 4)))
    for found, more in ((toxicity.score_toxicity(frame, machine, keep=frame.columns), ["score_", "predicted_"]), (quality_rules.judge_quality(frame, [], keep=frame.columns), [*(f"{c}_" if c in ("n_words", "n_lines") else c for c in quality_rules.COUNTS), "base_failed_", "kept_"])):
        assert found.columns == [*frame.columns, *more]
        assert Counter(tuple(r)[: len(frame.columns)] for r in found.collect()) == want
    assert Counter(map(tuple, toxicity.without_toxic(frame, machine).collect())) == want
    left = quality_rules.without_bad(frame, [])
    assert left.columns == frame.columns and {r["kept"] for r in left.collect()} == {"00", "10", "20"}
    one = near_dedup.keep_one(frame)
    assert one.columns == frame.columns and sorted(r["kept"] for r in one.collect())[-2:] == ["30", "40"] and one.count() == 3
    assert sharding.shuffle_to_shards(frame, 2).drop("shard", "slot").count() == 5
    for part in (toxicity.without_toxic(frame.limit(0), machine), quality_rules.without_bad(frame.limit(0), []), near_dedup.keep_one(frame.limit(0))):
        assert part.collect() == []


def test_one_row_of_each_group_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = a.replace("a39", "other")
    rows = [(5, a), (1, a), (None, a), (2, near), (2, b), (None, b), (7, "alone"), (7, "alone"), (3, None), (3, None), (4, " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, near_dedup.keep_one(frame).collect()))
    assert got == Counter([(1, a), (2, b), (7, "alone"), (3, None), (3, None), (4, " ")])


def test_labels_that_repeat_or_contradict(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (3, None), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (9, 1), (3, 7)], "doc_id long, toxic int")
    got = labelled.labelled_sample(docs, labels, "toxic", 10, learn_only=False).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 1), (3, None, 0)]


def family(seed, documents, words=150, edits=(5, 9)):
    """Texts about 0.75 alike, of one text that is not among them."""
    rng, out = np.random.default_rng(seed), {}
    base = [f"s{seed}w{k}" for k in range(words)]
    for i in range(documents):
        own = list(base)
        for k in rng.choice(words, int(rng.integers(*edits)), replace=False):
            own[int(k)] = f"e{rng.integers(10**9)}" if rng.random() < 0.7 else f"c{rng.integers(4)}"
        out[i] = " ".join(own)
    return out


@pytest.mark.parametrize(("edits", "percent", "width"), [((5, 9), 85, 3), ((1, 8), 85, 3), ((2, 5), 80, 5), ((1, 14), 90, 3)])
def test_boilerplate_families(spark, edits, percent, width):
    texts = {}
    for seed in range(3):
        texts |= {len(texts) + i: t for i, t in enumerate(family(seed, 90, edits=edits).values())}
    texts |= {len(texts): texts[0], len(texts) + 1: " ".join(texts[0].split()[:75] + texts[95].split()[75:])}
    want, _ = brute_components(texts, width, percent)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame, width=width, percent=percent).collect()}
    assert got == want and 3 < len(set(want.values()))


def test_token_files_by_sequence(spark, tmp_path):
    tok = Tokenizer.from_file(BYTE)
    some = [(i, " ".join(f"w{i}x{k}" for k in range(n))) for i, n in enumerate([40, 0, 300, 7, 1, 90])]
    manifest = token_files.write_token_files(spark.createDataFrame(some, "doc_id long, text string"), BYTE, str(tmp_path), sequence_length=16, rows_per_file=100, batch_rows=4)
    [said] = manifest.collect()
    stream = np.array([t for _, text in some for t in [*tok.encode(text, add_special_tokens=False).ids, 0]])
    reader, index = token_files.open_token_file(said["folder"], said["name"])
    rows = [reader.get_batch(k).num_rows for k in range(reader.num_record_batches)]
    assert set(rows[:-1]) == {4} and index.num_rows == 6 and said["n_tokens"] == len(stream)
    mapped = reader.get_batch(0).column("mask").flatten().buffers()[1]
    for k in range(sum(rows)):
        ids, mask = token_files.sequence(reader, k)
        own = stream[16 * k : 16 * k + 16]
        assert ids.dtype == np.uint16 and ids[: len(own)].tolist() == own.tolist() and token_files.unpacked_mask(mask, 16).tolist() == [True] * len(own) + [False] * (16 - len(own))
        assert not ids.flags.owndata and not mask.flags.owndata
    assert token_files.sequence(reader, 0)[1].__array_interface__["data"][0] == mapped.address
    for beyond in (-1, sum(rows)):
        with pytest.raises(IndexError):
            token_files.sequence(reader, beyond)


def test_token_files_refuse_ids_too_large(tmp_path):

    writer = token_files._Writer(str(tmp_path), "part", 0, pa.uint16(), pa.int64(), 4, 2)
    with pytest.raises(ValueError, match="70000"):
        writer.add(pa.array([1]), np.array([70000, 0], np.uint32), np.array([2]))
    writer = token_files._Writer(str(tmp_path), "wide", 0, pa.uint32(), pa.int64(), 4, 2)
    writer.add(pa.array([1]), np.array([70000, 0], np.uint32), np.array([2]))
    writer.close()
    ids, mask = token_files.sequence(token_files.open_token_file(str(tmp_path), "wide")[0], 0)
    assert ids.tolist() == [70000, 0, 0, 0] and token_files.unpacked_mask(mask, 4).tolist() == [True, True, False, False]
    empty = token_files._Writer(str(tmp_path), "empty", 0, pa.uint16(), pa.int64(), 4, 2)
    empty.close()
    reader, index = token_files.open_token_file(str(tmp_path), "empty")
    assert reader.num_record_batches == index.num_rows == 0
    with pytest.raises(IndexError):
        token_files.sequence(reader, 0)


@pytest.mark.parametrize("most", [3, 1000])
def test_limits_change_no_result(spark, tmp_path, most):
    rows = [(i, f"text {i % 5} " * (i % 4)) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(ordering.range_bounds(frame, "doc_id", 2, most)) == min(most, 30) - 1
    manifest = token_files.write_token_files(frame, BYTE, str(tmp_path), sequence_length=8, rows_per_file=2, most_ranges=most)
    got = token_files.with_global_starts(token_files.read_token_files(manifest), manifest).orderBy("doc_id").collect()
    tok, at = Tokenizer.from_file(BYTE), 0
    for r, (i, text) in zip(got, rows, strict=True):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (i, at, ids)
        at += len(ids)
    dealt = sharding.shuffle_to_shards(frame, 3, rows_per_bin=1, most_bins=most).collect()
    assert Counter(r["shard"] for r in dealt) == {0: 20, 1: 20, 2: 20} and all(sorted(r["slot"] for r in dealt if r["shard"] == s) == list(range(20)) for s in range(3))


def test_scores_do_not_depend_on_blocks_or_buckets(spark):
    frame = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 23))) for i in range(50)], "doc_id long, text string").repartition(3)
    key = lambda d: sorted((r["doc_id"], r["n_words"], round(r["log_score"], 9)) for r in d.collect())
    whole = key(lm_scoring.score_documents(frame))
    assert key(lm_scoring.score_documents(frame, block_chars=100, bucket_bytes=50)) == whole
    for blocks in (1, 3):  # sums in groups of so many blocks
        assert key(lm_scoring.score_documents(frame, block_chars=100, bucket_bytes=50, group_blocks=blocks)) == whole


def test_megabyte_texts_and_pages(spark):
    """Rows of megabytes go to Python a slice of a batch at a time."""
    words = [" ".join(f"w{(i * k * k) % 997}" for k in range(180_000)) for i in range(1, 5)]
    rows = [(i, f"http://x/{i}", t) for i, t in enumerate([words[0], "short", words[1], None, words[2], words[0], "", words[3]])]
    frame = spark.createDataFrame(rows, "doc_id long, url string, text string").repartition(1)
    cuts = list(tokens.byte_slices(pa.array([t for _, _, t in rows])))
    assert len(cuts) > 2 and [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and all(sum(len(t or "") for _, _, t in rows[a:b]) <= 2_000_000 for a, b in cuts)
    scored = {r["doc_id"]: r for r in lm_scoring.score_documents(frame, block_chars=1_000_000).collect()}
    assert scored[0]["n_words"] == 180_000 and scored[0]["log_score"] == scored[5]["log_score"] and scored[3]["n_words"] == 0
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint_documents(frame.where("doc_id in (1, 2)")).collect()}
    assert prints[2] == fingerprints.fingerprint(words[1]) and prints[1] == fingerprints.fingerprint("short")
    pages = frame.select(F.col("doc_id").alias("page_id"), "url", F.col("text").alias("html"))
    found = {r["page_id"]: r for r in warc.captured_pages(warc.assemble(warc.read_records(warc.write_archives(pages)))).collect()}
    assert found[2]["payload_bytes"] == len(words[1]) and found[5]["refers_to"] == 0 and found[3]["payload_bytes"] == 0


def test_archives_of_hot_and_repeated_pages(spark, tmp_path):
    rng = np.random.default_rng(2)
    payloads = ["hot " * 40, "warm " * 30, "short", None, "", *("p%d " % k * 30 for k in range(6))]
    rows = [(None if rng.random() < 0.1 else int(rng.integers(12)), f"u{rng.integers(3)}", payloads[int(rng.integers(11)) if rng.random() < 0.5 else 0]) for _ in range(150)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.captured_pages(warc.assemble(warc.read_records(warc.write_archives(frame, str(tmp_path))))).collect())
    first = {p: min((i for i, _, q in rows if q == p and i is not None), default=None) for p in payloads}
    want = Counter()
    for i, _, p in rows:
        raw = (p or "").encode()
        revisit = len(raw) >= 100 and first[p] is not None and i != first[p]
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None] += 1
    assert got == want


def test_packing_fills_sequences(spark, texts):
    rows = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), BYTE).collect()
    used = sum(r["length"] for r in rows)
    assert used / (1024 * len({r["sequence_id"] for r in rows})) > 0.95


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from wavemark.llm import storage

    class Context:
        master = "spark://somewhere:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)
    assert os.path.isabs(storage.shared_dir(spark).removeprefix("file:"))


def test_components_of_chains_and_stars(spark, monkeypatch):
    rng = np.random.default_rng(3)
    order = rng.permutation(1500)
    edges = [(int(a), int(b)) for a, b in zip(order[:800], order[1:800], strict=False)] + [(int(order[900]), int(k)) for k in order[901:1000]] + [(int(a), int(b)) for a, b in rng.choice(order[1000:], (300, 2))]
    rounds, real = [], near_dedup.written_table
    monkeypatch.setattr(near_dedup, "written_table", lambda df, label: rounds.append(label) or real(df, label))
    got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {i: i for e in edges for i in e}
    for a, b in edges:
        low, high = sorted((group[a], group[b]))
        group = {i: low if g == high else g for i, g in group.items()} if low != high else group
    assert got == group and len(rounds) < 18


@pytest.mark.parametrize(("choices", "seed"), [(2, 0), (5, 1)])
def test_templated_texts_do_not_meet_in_pairs(spark, monkeypatch, choices, seed):
    """Texts of slots with a few choices each: many nodes share each difference, few are linked."""
    rng, made, written = np.random.default_rng(seed), {}, near_dedup.written_table
    slots = [[" ".join(f"s{i}o{o}w{k}" for k in range(10)) for o in range(choices)] for i in range(20 if choices == 2 else 8)]
    texts = [" ".join(str(rng.choice(s)) for s in slots) + (f" note {i}" if i % 4 == 0 else "") for i in range(600)]

    def counted(df, label):
        out = written(df, label)
        made.setdefault(label, []).append(out)
        return out

    monkeypatch.setattr(near_dedup, "written_table", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame, width=3, percent=85).collect()}
    assert found == brute_components(dict(enumerate(texts)), 3, 85)[0]
    pairs = made["candidates"][-1].count()
    assert pairs < 600 * near_dedup.FREQUENT, pairs  # of 179,700
