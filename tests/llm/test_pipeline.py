"""The pipeline's stages on a planted table."""

import random
import sys

import __spark_entry__ as E
import corpus_pipeline
from rankscope.llm import packing, sentences, simhash
from rankscope.llm.common import text_key

from .test_corpus_operators import DOCS


def planted(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(900)]

    def sentence():
        return " ".join(rng.choices(vocabulary, k=rng.randint(6, 14))).capitalize() + "."

    def prose(n):
        return " ".join(sentence() for _ in range(n))
    passage = prose(8)
    texts = [prose(rng.randint(12, 30)) for _ in range(60)]
    copy = texts[4].upper()
    shared = [f"{prose(10)} {passage} {prose(10)}" for _ in range(3)]
    secret = f"{prose(12)} password = hunter2hunter2 {prose(3)}"
    rows = [*texts, copy, *shared, secret, "too short", None, ""]
    return spark.createDataFrame([(k, t, "en", f"s{k % 4}", None if t is None else len(t)) for k, t in enumerate(rows)],
                                 DOCS), passage


def test_stages_keep_clean_documents(spark, tmp_path):
    docs, passage = planted(spark)
    n = docs.count()
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        ids[name] = sorted(r.doc_id for r in out.select("doc_id").distinct().collect())
        docs, before = out, docs
        if name == "substring_dedup":
            texts = {r.doc_id: r.text for r in out.collect()}
            middle = passage[len(passage) // 3:len(passage) // 2]
            assert sum(middle in t for t in texts.values()) == 1
            old = {r.doc_id: r.text for r in before.collect()}
            assert all(texts[k] == old[k] for k in range(60))
        if name == "secret_scan":
            text = next(r.text for r in out.collect() if r.doc_id == n - 4)
            assert "hunter2" not in text and "[SECRET]" in text
    assert ids["quality_rules"] == list(range(n - 3))
    assert ids["simhash_dedup"] == [k for k in range(n - 3) if k != 60]
    assert ids["simhash_dedup"] == ids["substring_dedup"] == ids["secret_scan"] == ids["best_fit_packing"]


def test_run_matches_the_stages(spark, tmp_path):
    docs, _ = planted(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert rows.doc_id.nunique() == docs.count() - 4
    assert (rows.groupby("bin_id").n_words.sum() <= 2048).all()
    texts = {(r.doc_id, r.key): r.text for r in docs.select("doc_id", "text", text_key("text").alias("key")).collect()}
    whole = [r for r in rows.itertuples() if (r.doc_id, r.text_key) in texts]  # those that no stage has changed
    assert len(whole) > 50 and all(len(texts[r.doc_id, r.text_key].split()) >= r.first_word + r.n_words for r in whole)


def test_repeated_and_null_ids_and_clashing_columns(spark, tmp_path):
    docs, _ = planted(spark)
    odd = docs.where("doc_id in (3, 7, 9)")
    docs = (docs.union(odd).union(odd.withColumn("doc_id", odd.doc_id * 0 + 5)).union(odd.selectExpr(
        "cast(null as long) as doc_id", "concat(text, ' And a new end of it, with some more words.') as text", "lang", "source",
        "n_chars")).selectExpr("*", "'x' as text_key", "'y' as fp", "'z' as bin_id", "1 as g", "2 as kept"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    first = {r.text: None for r in docs.collect()}
    # texts 7 and 9 stay under the smaller id 5
    assert len(first) > 60 and rows.doc_id.nunique() == 62 and rows.duplicated(["doc_id", "text_key", "piece"]).sum() == 0


def test_empty_table(spark, tmp_path):
    docs, _ = planted(spark)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert simhash.SHINGLE == 3 and sentences.MIN_SENTENCES == 2


def test_packing_keeps_near_copies_apart(spark):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(500)]
        rows.append((k, " ".join(words), "en", f"s{k}", 0))
        if k % 2:
            rows.append((100 + k, " ".join(words[:250] + ["other"] + words[251:]), "en", f"t{k}", 0))
    rows += [(None, None, "en", "n", 0)] * 60
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    clusters = simhash.text_clusters(docs)
    of = {r.key: r.cluster for r in clusters.collect()}
    assert len(of) == 61 and len(set(of.values())) < 45
    out = packing.pack(docs, group_rows=24, clusters=clusters).toPandas()
    out["cluster"] = out.text_key.map(of)
    assert not out.duplicated(["bin_id", "cluster"]).any() and len(out) == 120
    empty = out[out.n_words == 0]
    assert len(empty) == 60 and empty.groupby(empty.bin_id // 2 ** 32).size().max() < 30  # no group has all the copies


def test_entry_without_an_optional_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("rankscope.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "regex", None)
    names = E.queries()
    assert len(names) > 50 and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert not any(n.startswith("op") for n in E.oracle_sql())
