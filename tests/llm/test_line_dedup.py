import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from labelmill.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs, min_chars=1, keep_first=False):
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    docs, first = defaultdict(set), {}
    for i, t in rows:
        for p, line in enumerate(t.split("\n")):
            docs[lower(line.strip(SPACE))].add((i, t))
    out = {}
    for i, t in rows:
        lines, keep = t.split("\n"), []
        for line in lines:
            key = lower(line.strip(SPACE))
            gone = len(key) >= min_chars and len(docs[key]) >= min_docs
            if gone and keep_first and key not in first:
                first[key], gone = (i, t), False
            if not gone:
                keep.append(line)
        out[i, t] = (len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


def result(docs, **options):
    kept = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs, **options))
    rows = kept.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("sha")).collect()
    return [((r.doc_id, r.text), (r.n_lines, r.n_dropped, r.sha)) for r in rows]


def test_random_lines_over_many_partitions(spark):
    rng = random.Random(3)
    pool = [f"{c}Line {i}" for i in range(40) for c in ("", " ", "\t")] + ["", "  ", "É", "é", "hot"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {i} {rng.random()}" for _ in range(rng.randrange(9))) + "\nHOT") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for options in ({"min_docs": 10}, {"min_docs": 30, "min_chars": 3}, {"min_docs": 5, "keep_first": True}):
            got = result(docs, **options)
            assert len(got) == len(rows) and dict(got) == brute(rows, **options)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_batches_that_cut_hashes(spark):
    rows = [(i, f"a\nb\nA\nown {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for options in ({"min_docs": 10}, {"min_docs": 51}, {"min_docs": 10, "keep_first": True}):
            assert dict(result(docs, **options)) == brute(rows, **options)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_nasty_documents(nasty, nasty_texts, nothing):
    got = result(nasty.select("doc_id", "text"), min_docs=10)
    want = brute(nasty_texts, 10)
    assert len(got) == len(nasty_texts) and dict(got) == want
    kept = line_dedup.deduplicated(nasty)
    assert kept.columns == nasty.columns and kept.filter("text is null").count() == 2
    assert {r.text for r in kept.filter("doc_id >= 20").collect()} == {f"own {i}\n\n" for i in range(12)}
    assert line_dedup.deduplicated(nothing).count() == 0
