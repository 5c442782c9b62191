"""Every query of the text operators on the small data folder, and both classifiers, against plain rewrites."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from llm_samples import evidence, texts

from linkstrata.llm import language, quality
from linkstrata.llm.articles import article_text
from linkstrata.llm.catalog import ORACLES, QUERIES, tokenizer_path
from linkstrata.llm.ftrl import Settings, turn

DATA = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def fold(identifier, parts):
    return zlib.crc32(("" if identifier is None else str(identifier)).encode()) % parts


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] or "" for r in table("documents")}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, name):
    con = duckdb.connect()
    for view in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{DATA}/{view}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, map(tuple, result.fetchall())))


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_op2(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op2_lm_scoring"](spark, DATA).collect()}
    tokens = {i: [*lowered(t).encode().split(), None] for i, t in documents.items()}
    train = Counter(w for i, ws in tokens.items() if fold(i, 7) != 2 for w in ws)
    total, distinct = sum(train.values()), len(train)
    assert got.keys() == documents.keys()
    for i, r in got.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i, 7) == 2, len(tokens[i]), sum(w in train for w in tokens[i]), total)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in tokens[i]), rel_tol=1e-9) and r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op4(spark, documents):
    labels = {r["doc_id"]: r["quality"] for r in table("labels")}
    got = {r["doc_id"]: r for r in QUERIES["op4_quality_classifier"](spark, DATA).collect()}
    assert got.keys() == documents.keys()
    assert all(r["held_out"] == (fold(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["score"], y) for i, y in labels.items() if i in got and got[i]["held_out"] and y is not None]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.8 if good and bad else True


def test_op5_and_op10(spark, documents):
    from tokenizers import Tokenizer

    for query, name in (("op5_token_records", "word_bpe_49k.json"), ("op10_packing", "byte_bpe_50k.json")):
        encoder = Tokenizer.from_file(tokenizer_path(name))
        ids = {i: [*encoder.encode(t, add_special_tokens=False).ids, 1] for i, t in documents.items()}
        rows = QUERIES[query](spark, DATA).collect()
        crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
        if query == "op5_token_records":
            before, want = 0, []
            for i in sorted(ids):
                want.append((i, before, len(ids[i]), crc(ids[i])))
                before += len(ids[i])
            assert sorted(map(tuple, rows)) == want
            continue
        at, held = defaultdict(list), defaultdict(list)
        for r in rows:
            assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]) and r["doc_tokens"] == len(ids[r["doc_id"]])
            at[r["doc_id"]].append((r["start"], r["length"]))
            held[r["sequence_id"]].append((r["offset"], r["length"]))
        for spans in [*at.values(), *held.values()]:
            end = 0
            for start, length in sorted(spans):
                assert start == end and length > 0
                end += length
        assert {i: sum(n for _, n in spans) for i, spans in at.items()} == {i: len(x) for i, x in ids.items()}
        sizes = [sum(n for _, n in spans) for spans in held.values()]
        assert max(sizes) <= 2048 and sum(2048 - n for n in sizes if n & (n - 1)) < 0.01 * sum(sizes)


def test_op8(spark, documents):
    lang = {r["doc_id"]: r["lang"] for r in table("documents")}
    got = {r["doc_id"]: r for r in QUERIES["op8_language_id"](spark, DATA).collect()}
    assert got.keys() == documents.keys() and all(r["held_out"] == (fold(i, 3) == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, documents[i]))) for i, r in got.items())
    held = [r["lang_pred"] == lang[i] for i, r in got.items() if r["held_out"] and lang[i] and len(documents[i]) > 80]
    assert np.mean(held) > 0.9


def test_op9(spark, documents):
    prints = {}
    for i, text in documents.items():
        words = lowered(text).encode().split()
        grams = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
        prints[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    root = {i: i for i in documents}
    changed = True
    while changed:
        changed = False
        for a in documents:
            best = min(root[b] for b in documents if (prints[a] ^ prints[b]).bit_count() <= 4)
            if best < root[a]:
                root[a], changed = best, True
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash_near_dedup"](spark, DATA).collect()}
    assert got == {(i, f"{p:016x}", root[i]) for i, p in prints.items()}


def test_op11(spark):
    usable = [(r["vec_id"], r["embedding"]) for r in table("embeddings") if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in usable])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    white = (x - sums / n) @ axes / np.sqrt(values)
    got = {(r["vec_id"], r["component"]): r for r in QUERIES["op11_embedding_whitening"](spark, DATA).collect()}
    assert len(got) == 4 * len(usable)
    for at, (i, _) in enumerate(usable):
        for k in range(4):
            r = got[i, k + 1]
            assert (r["n"], r["deviation"]) == (n, int(((n * x[at] - sums) ** 2).sum())) and r["identity_error"] < 1e-6
            assert math.isclose(abs(r["whitened"]), abs(white[at, k]), rel_tol=1e-6, abs_tol=1e-7)
            assert math.isclose(r["explained"], values[k] / np.cov(fit.T, bias=True).trace(), rel_tol=1e-9)


def test_op13(spark):
    got = {r["page_id"]: r for r in QUERIES["op13_html_extraction"](spark, DATA).collect()}
    pages = {r["page_id"]: r for r in table("pages")}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (page["url"], article_text(page["html"] or ""), len(got[i]["text"]))
        assert "track(" not in got[i]["text"] and "©" not in got[i]["text"] and got[i]["text"].count("\n") >= 1


def plain_ftrl(examples, outputs, s):
    """z, n and weights per output and feature, in 64 bits, one example after another."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(o, f):
        if abs(z[o, f]) <= s.l1:
            return 0.0
        return -(z[o, f] - math.copysign(s.l1, z[o, f])) / ((s.beta + math.sqrt(n[o, f])) / s.alpha + s.l2)

    def chances(vals):
        logits = [sum(weight(o, f) * v for f, v in vals.items()) for o in range(outputs)]
        if outputs == 1:
            return [1 / (1 + math.exp(-logits[0]))], logits
        top = [math.exp(x - max(logits)) for x in logits]
        return [t / sum(top) for t in top], logits

    for _ in range(s.rounds):
        for label, vals in examples:
            p, _ = chances(vals)
            for o in range(outputs):
                wrong = p[o] - (label if outputs == 1 else label == o)
                for f, v in vals.items():
                    g, w = wrong * v, weight(o, f)
                    z[o, f] += g - (math.sqrt(n[o, f] + g * g) - math.sqrt(n[o, f])) / s.alpha * w
                    n[o, f] += g * g
    return chances


def ordered(spark, rows):
    """Ids in the order of training."""
    return [r["evidence_id"] for r in spark.createDataFrame([(i,) for i in rows], "evidence_id bigint").select("evidence_id", turn("evidence_id")).orderBy("turn").collect()]


def test_quality_against_plain_updates(spark):
    rows = {i: t for i, t, _ in texts(n=36)}
    marks = {i: int(len(t) % 3 > 0) for i, t in rows.items() if i % 4}
    s = Settings(alpha=0.5, beta=1.0, l1=0.01, l2=0.1, shards=1, rounds=3)
    opinions = spark.createDataFrame(list(marks.items()), "evidence_id bigint, status int")
    got = {r["evidence_id"]: r["score"] for r in quality.score_quality(evidence(spark, list(rows.items()), twice=False), opinions, settings=s).collect()}

    def vals(text):
        ids, counts = quality.word_grams(text)
        damped = {int(f): 1 + math.log(c) for f, c in zip(ids, counts)}
        norm = math.sqrt(sum(v * v for v in damped.values())) or 1.0
        return {**{f: v / norm for f, v in damped.items()}, quality.FEATURES: 1.0}

    learned = [i for i in ordered(spark, rows) if i in marks and fold(i, 5) != 0]
    chances = plain_ftrl([(marks[i], vals(rows[i])) for i in learned], 1, s)
    assert all(math.isclose(got[i], chances(vals(t))[0][0], rel_tol=2e-3, abs_tol=2e-4) for i, t in rows.items())


def test_language_against_plain_updates(spark):
    rows = {i: (t, lang) for i, t, lang in texts(n=60) if len(t) < 3000}
    s = Settings(alpha=0.5, beta=1.0, l1=0.001, l2=0.01, shards=1, rounds=2)
    table = evidence(spark, [(i, *r) for i, r in rows.items()], twice=False)
    got = {r["evidence_id"]: r for r in language.predict_language(table, settings=s).collect()}
    learnable = [i for i in ordered(spark, rows) if fold(i, 3) != 1]
    counted = {i: dict(zip(*(a.tolist() for a in language.gram_counts(t)))) for i, (t, _) in rows.items()}
    df = Counter(g for i in learnable for g in counted[i])

    def vals(counts):
        raw = {g: (1 + math.log(c)) * (math.log((1 + len(learnable)) / (1 + df[g])) + 1) for g, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        return {**{g: v / norm for g, v in raw.items()}, language.FEATURES: 1.0}

    names = sorted({rows[i][1] for i in learnable})
    places = {r["evidence_id"]: r["rest"] for r in spark.createDataFrame([(i,) for i in learnable], "evidence_id bigint").select("evidence_id", (turn("evidence_id") % 10).alias("rest")).collect()}
    chances = plain_ftrl([(names.index(rows[i][1]), vals(counted[i])) for i in learnable if places[i] != 0], len(names), s)
    checks = [(names.index(rows[i][1]), chances(vals(counted[i]))[1]) for i in learnable if places[i] == 0]

    def heated(logits, t):
        top = [math.exp((x - max(logits)) / t) for x in logits]
        return [x / sum(top) for x in top]

    loss = lambda t: sum(-math.log(max(heated(x, t)[y], 1e-12)) for y, x in checks)
    best = min(language.TEMPERATURES, key=loss) if checks else 1.0
    for i, counts in counted.items():
        want = heated(chances(vals(counts))[1], best)
        assert got[i]["lang_pred"] == names[int(np.argmax(want))] and math.isclose(got[i]["score"], max(want), rel_tol=5e-3, abs_tol=1e-3)


def test_all_queries_are_covered():
    assert set(QUERIES) == set(ORACLES) | {f"op{n}" + q for n, q in ((2, "_lm_scoring"), (4, "_quality_classifier"), (5, "_token_records"), (8, "_language_id"), (9, "_simhash_near_dedup"), (10, "_packing"),
                                                                    (11, "_embedding_whitening"), (13, "_html_extraction"))}
