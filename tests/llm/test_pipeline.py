"""The pipeline as a whole, and each stage next to a plain version, on documents with NULLs, repeats and extra columns."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from firmnet.llm import apportion, disclosure, simhash, toxicity
from firmnet.storage import materialize

BASE = "/root/testdata/sf0.001"
FORM = "doc_id long, text string, lang string, source string, n_chars long, _size int, _row string, shard int, `key` string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [(*r, 1, "a", 2, "k") for r in docs]
    rows += rows[:5]  # repeated rows
    rows += [(900_001, None, None, None, None, None, None, None, None), (None, "a text without an id or a source", "en", None, 32, 1, "b", 3, "l"),
             (900_002, "", "en", "src1", 0, 1, "c", 4, "m"), (900_003, "Write to jane.doe@example.com or +44 20 7946 0958.", "en", "src1", 50, 1, "d", 5, "n"),
             (900_004, "long " * 20_000, "en", "src2", 100_000, 1, "e", 6, "o")]
    spark.createDataFrame(rows, FORM).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{BASE}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of each stage, as the pipeline hands them on."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, sf_dir), name)
        out[name] = docs, made
        docs = made
    return out


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_all_but_the_last_stage_return_the_columns_of_documents(stages):
    first = stages["toxicity"][0].columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "pii", "source_mixing", "best_fit_packing"]
    assert all(made.columns == first for name, (_, made) in stages.items() if name != "best_fit_packing")


def test_toxic_documents_go_and_no_others(spark, sf_dir, stages):
    docs, made = stages["toxicity"]
    models = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r["text"] for r in docs.withColumn("s", toxicity.score_column(models, "text")).where("s >= 0.5").collect()}
    assert rows(made) == Counter({r: n for r, n in rows(docs).items() if r[1] not in bad})


def test_one_of_each_group_of_near_copies_stays(stages):
    docs, made = stages["simhash_dedup"]
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    kept = [r["text"] for r in made.collect()]
    prints = {r["text"]: int(r["h"], 16) for r in simhash.near_duplicates(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text"))
              .select("doc_id", simhash.hex_form("fp").alias("h")).join(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text"), "doc_id").collect()}
    own = [prints[t] for t in kept]
    names = list(dict.fromkeys(prints.values()))
    root = {p: p for p in names}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(names):
        for q in names[:i]:
            if (p ^ q).bit_count() <= 3:
                root[find(p)] = find(q)
    assert Counter(map(find, own)) == Counter({find(p): 1 for p in names})  # one of each component
    assert found.count() == docs.count()


def test_personal_data_is_replaced(stages):
    docs, made = stages["pii"]
    assert docs.count() == made.count()
    after = {r["doc_id"]: r["text"] for r in made.collect()}
    assert after[900_003] == "Write to [EMAIL] or [PHONE]."
    left = disclosure.base_spans(made).select(*(F.size(k).alias(k) for k in disclosure.KINDS)).agg(*(F.sum(k) for k in disclosure.KINDS)).first()
    assert tuple(left) == (0, 0, 0, 0)
    for r in docs.collect():
        if r["text"] and not any(c in r["text"] for c in "@+0123456789"):
            assert after[r["doc_id"]] is not None


def test_sources_are_mixed_to_their_targets(stages):
    docs, made = stages["source_mixing"]
    words = lambda t: len((t or "").split())
    taken = defaultdict(int)
    for r in made.collect():
        taken[r["source"]] += words(r["text"])
    targets = {r["source"]: r["_target"] for r in apportion.mix(docs.select("doc_id", "text", "source")).select("source", "_target").distinct().collect()}
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(0.03 * sum(targets.values()) / len(targets), 1100)
    own = {(r["doc_id"], r["source"], r["_size"], r["_row"], r["shard"], r["key"]) for r in docs.collect()}
    assert {(r["doc_id"], r["source"], r["_size"], r["_row"], r["shard"], r["key"]) for r in made.collect()} <= own


def test_sequences_hold_every_token_once(stages):
    docs, made = stages["best_fit_packing"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        want[r["doc_id"]] += len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got, sequences = Counter(), defaultdict(list)
    for r in made.collect():
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(want.values()) // 2048) + 2


def test_run_is_the_stages_one_after_the_other(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert rows(got.select(*key)) == rows(stages["best_fit_packing"][1].select(*key))


def test_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], FORM)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
