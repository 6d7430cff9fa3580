"""The pipeline against a plain version of its stages."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tests_llm_helpers import brute_components, documents, shingle_sets, similar, tokenizer


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    df, by_id, rows = documents(spark, 4, 25)
    table = df.select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    stages = {}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "_"))
        docs.write.parquet(path)
        docs = stages[name] = spark.read.parquet(path)
        if name != "byte-level BPE":
            assert docs.columns == table.columns
    ids = lambda name: sorted(r.doc_id for r in stages[name].select("doc_id").collect())
    lettered = {i: t for i, t in by_id.items() if any(c.isalpha() for c in t)}
    assert ids("language ID") == sorted(lettered)
    groups = {}
    for i, t in lettered.items():
        groups.setdefault(t, []).append(i)
    unique = {max(g): t for t, g in groups.items()}
    assert ids("exact dedup") == sorted(unique)
    sets = shingle_sets(unique)
    roots = set(brute_components(sets, similar).values())
    assert ids("n-gram Jaccard join") == sorted(roots)
    mixed = stages["mixing"].collect()
    assert {r.doc_id for r in mixed} <= roots and len(mixed) > len(roots) // 2
    ref = tokenizer()
    want = sorted((r.doc_id, len(x := ref.encode_ordinary(r.text)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and public_tokenizers.PATTERN


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, rows that repeat, a long text, clashing columns; then no rows at all."""
    import corpus_pipeline

    rows = [(i, f"word{i} " * 30 + "and so on", "en", "s", 5) for i in range(12)]
    rows += [(None, "no id at all here", "en", "s", 1), (20, None, None, None, None), (21, "", "en", "s", 0), (22, "12 34", "fr", None, 2), (23, "long " * 60_000, "en", None, 9), (24, "one", None, "t", 3), (3, rows[3][1], "en", "s", 5), (None, "no id at all here", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, clash in enumerate(("_id", "first", "key", "size", "_copy", "doc", "word")):
        df = df.withColumn(clash, F.lit(k))
    for name, table in (("full", df), ("none", df.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage_name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(str(tmp_path / name / stage_name.replace(" ", "_")))
            docs = spark.read.parquet(str(tmp_path / name / stage_name.replace(" ", "_")))
            if stage_name != "byte-level BPE":
                assert docs.columns == df.columns, stage_name
            if stage_name == "n-gram Jaccard join" and name == "full":
                ids = [r.doc_id for r in docs.collect()]
                assert {i for i in ids if i is not None} == {*range(12), 23, 24} and None in ids
        assert (docs.count() > 0) == (name == "full")


def test_registered():
    from coffer.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
