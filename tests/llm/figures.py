"""Measures what two named methods cost when they are applied to a whole corpus as rows; README quotes the figures.

python tests/llm/figures.py FOLDER... (of test tables)
"""

import glob
import os
import resource
import sys
import tempfile

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession  # noqa: E402

from glossarium.llm import op10_jaccard_join as op10  # noqa: E402
from glossarium.llm.common import slices  # noqa: E402


def sorted_triples(spark, docs, local):
    """The difference cover's first step over all suffixes: two of three positions, each with its three bytes, sorted. Shuffled bytes for each byte of text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                t = np.frombuffer(b"".join(x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()), np.uint8).astype(np.int32)
                at = np.arange(len(t) - 2)
                at = at[at % 3 != 0]
                yield pa.RecordBatch.from_arrays([pa.array((t[at] << 16) | (t[at + 1] << 8) | t[at + 2]), pa.array(part.column("doc_id")[0].as_py() * 2**32 + at)], names=["triple", "at"])

    before = os.times()
    docs.select("doc_id", "text").mapInArrow(run, "triple int, at long").orderBy("triple").write.format("noop").mode("overwrite").save()
    after = os.times()
    shuffled = sum(os.path.getsize(f) for f in glob.glob(f"{local}/**/shuffle_*.data", recursive=True))
    return shuffled, after.children_user + after.user - before.children_user - before.user


def replicas(texts, pivots, words=4, percent=85):
    """How many of the Voronoi regions of random pivots get a copy of a document under the window of twice the radius, on average."""
    rng = np.random.default_rng(1)
    sets = [s for s in (op10.shingles(t, words) for t in texts) if len(s)]
    some = [sets[k] for k in rng.choice(len(sets), pivots, replace=False)]
    far = np.empty((len(sets), pivots))
    for j, p in enumerate(some):
        for i, s in enumerate(sets):
            both = len(np.intersect1d(s, p, assume_unique=True))
            far[i, j] = 1 - both / (len(s) + len(p) - both)
    return float((far <= far.min(1, keepdims=True) + 2 * (1 - percent / 100)).sum(1).mean())


def main(folders):
    for folder in folders:
        local = tempfile.mkdtemp()
        spark = SparkSession.builder.master("local[4]").config("spark.local.dir", local).config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        size = docs.selectExpr("sum(octet_length(text))").first()[0]
        shuffled, _ = sorted_triples(spark, docs, local)
        texts = [r.text for r in docs.select("text").orderBy("doc_id").collect()]
        print(folder, f"{size / 1e6:.1f} MB of text; sorted triples: {shuffled / size:.1f} bytes shuffled a byte;", "copies of a document:", ", ".join(f"{replicas(texts, k):.1f} of {k} regions" for k in (16, 64)), f"; {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3:.0f} MB", flush=True)
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
