"""Pipeline stages against a plain rewrite, and the text queries against their SQL twins."""

import os
import struct
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
from llm_samples import sentence, texts
from test_duplicates import slow_fingerprint, slow_leaks
from tokenizers import Tokenizer

import corpus_pipeline as P
from linkstrata.llm.catalog import ORACLES, QUERIES
from linkstrata.llm.common import fresh_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content_hash string"


def documents(spark, rows):
    """Rows with a further column whose name an operator uses as well."""
    return spark.createDataFrame([(i, t, lang, "src", len(t or ""), "own") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    import random

    rng = random.Random(12)
    prose = [(1000 + i, sentence(rng, lang := rng.choice(["en", "de", "fr"]), rng.randint(12, 50)), lang) for i in range(150)]
    odd = [(None, None, None), (1, "", "en"), (2, "12 34 !!", "en"), (None, prose[0][1], "en"), (7, prose[1][1], None)]
    return [*texts(n=30), *prose, *odd, prose[5], prose[5], prose[6]]


def stored(spark, df):
    path = fresh_path(spark, "docs")
    df.write.parquet(path)
    return spark.read.parquet(path)


def content(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages(spark, rows, tmp_path):
    items = [(1, " ".join(rows[3][1].split()[:30])), (2, " ".join(rows[60][1].split()[2:20])), (3, None), (4, "never seen words of any kind in here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in P.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    language = stored(spark, P.language(spark, docs, str(tmp_path)))
    assert language.columns == docs.columns
    left = content(language)
    lost = [t for i, t in content(docs) if (i, t) not in left]
    assert all(t is None or len(t) < 9 for t in lost) and {None, "", "12 34 !!"} <= set(lost)

    exact = stored(spark, P.exact_dedup(spark, language, str(tmp_path)))
    groups = defaultdict(list)
    for i, t in left:
        groups[t].append(i)
    want = sorted(((max((i for i in ids if i is not None), default=None), t) for t, ids in groups.items()), key=repr)
    assert exact.columns == docs.columns and content(exact) == want and len(want) < len(left)

    near = stored(spark, P.near_dedup(spark, exact, str(tmp_path)))
    kept = content(near)
    prints = {t: slow_fingerprint(t) for _, t in want}
    parent = {t: t for t in prints}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[root(a)] = root(b)
    assert near.columns == docs.columns and set(kept) <= set(want)
    assert sorted(map(root, (t for _, t in kept))) == sorted({root(t) for t in prints}) and len(kept) < len(want)

    clean = stored(spark, P.decontaminate(spark, near, str(tmp_path)))
    leaks = {d for d, *_ in slow_leaks(list(enumerate(t for _, t in kept)), items)}
    assert clean.columns == docs.columns and content(clean) == [r for n, r in enumerate(kept) if n not in leaks] and leaks

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for p in P.packing(spark, clean, str(tmp_path)).collect():
        pieces[p["doc_id"]].append(p)
    for i, t in content(clean):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert b"".join(bytes(p["ids"]) for p in sorted(pieces[i], key=lambda p: p["start"])) == struct.pack(f"<{len(ids)}I", *ids)


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data folder")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr(list(r)) for r in result.fetchall())
