"""Each stage of the pipeline against a plain version of it, on its own input; the whole run; odd tables."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from loamstack.llm import binary_output, decontaminate, language_id, mixing, tokens

from .test_decontaminate import exhaustive
from .test_jaccard_join import brute as brute_links

KIND = "`a.b` int, doc_id bigint, text string, lang string, source string, n_chars bigint, `__maybe` int"
LETTERS = {"en": "abcde", "de": "fghij", "es": "klmno", "fr": "pqrst"}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choices(LETTERS[lang], k=rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(0, i, prose(rng, lang, rng.choice((20, 90, 300))), lang, f"s{i % 3}", 1, 2) for i in range(120) for lang in [rng.choice(list(LETTERS))]]
    items = [(k, prose(rng, "en", n)) for k, n in enumerate((4, 12, 40, 150))]
    for k, (_, item) in enumerate(items):
        out.append((0, 200 + k, f"{prose(rng, 'en', 40)} {item} {prose(rng, 'en', 50)}", "en", "s1", 1, 2))
    for k in range(12):
        w = out[k][2].split()
        w[5] = "zzz"
        out += [(0, 300 + k, " ".join(w), out[k][3], "s0", 1, 2), (0, 400 + k, out[k][2], out[k][3], "s2", 1, 2)]
    out += [(0, 500, None, "en", "s1", 1, 2), (0, 501, "", "de", "s1", 1, 2), (0, 502, "12 34", None, None, 1, 2), (0, None, prose(rng, "de", 30), None, None, None, None)]
    out += [(0, 503, prose(rng, "fr", 60_000), "fr", "s0", 1, 2), out[3], out[3]]
    return out, items


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows[0], KIND).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(rows[1], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def stage(name):
    return dict(P.STAGES)[name]


def test_language_stage(spark, folder, rows):
    docs = spark.createDataFrame(rows[0], KIND)
    model = language_id.train(docs)
    got = stage("language_id")(spark, docs, folder)
    assert got.columns == docs.columns
    want = Counter()
    for r in rows[0]:
        family, language, margin = model.decide(model.score([r[2] or ""])[0])
        if sum(c.isalpha() for c in r[2] or "") > 1 and margin >= language_id.MIN_MARGIN:
            want[r[1]] += 1
    assert Counter(r[1] for r in got.collect()) == want


def test_near_duplicate_stage(spark, folder, rows):
    docs = spark.createDataFrame(rows[0], KIND)
    got = stage("near_duplicates")(spark, docs, folder)
    assert got.columns == docs.columns
    lost = {i for i, lead, *_ in brute_links([(r[1], r[2]) for r in rows[0]]) if i != lead}
    assert Counter(r[1] for r in got.collect()) == Counter({r[1]: 1 for r in rows[0] if r[1] not in lost})


def test_decontamination_stage(spark, folder, rows):
    docs = spark.createDataFrame(rows[0], KIND)
    got = stage("decontamination")(spark, docs, folder)
    assert got.columns == docs.columns
    (index,) = decontaminate.indexes(spark.createDataFrame(rows[1], "item_id bigint, text string"))
    want = Counter()
    for r in rows[0]:
        ids = np.array([index.vocabulary.get(w, -1) for w in decontaminate.words(r[2])], np.int64)
        hit = set()
        for at in range(0, max(1, min(len(ids), 2000) - decontaminate.PASSAGE + decontaminate.STRIDE), decontaminate.STRIDE):
            hit |= {index.owner[e] for e in exhaustive(index, {int(t) for t in ids[at : at + decontaminate.PASSAGE] if t >= 0}, decontaminate.THRESHOLD)}
        shares = [[np.isin(part, decontaminate.codes(ids, len(index.vocabulary), n)).mean() for n, part in index.parts[i]] for i in hit]
        if not any(min(s) >= decontaminate.OVERLAP for s in shares):
            want[r[1]] += 1
    assert Counter(r[1] for r in got.collect()) == want
    assert not {200, 201, 202, 203} & want.keys()


def test_mixing_stage(spark, folder, rows):
    docs = spark.createDataFrame(rows[0], KIND)
    got = stage("mixing")(spark, docs, folder)
    assert got.columns == docs.columns
    sized = mixing.sized(docs.toDF("c0", "doc_id", "text", "lang", "source", "c5", "c6"), mixing.by_source_and_language(), mixing.SEED)
    plan, _ = mixing.plan_mix(sized, mixing.tempered())
    count = Counter(r[1] for r in got.collect())
    size = {r[1]: len((r[2] or "").split()) for r in rows[0]}
    flow = sum(n for by in plan.flows.values() for parts in by for _, n in parts)
    assert abs(sum(size[i] * n for i, n in count.items()) - flow) <= len(plan.flows) * mixing.EPOCHS * 2 * sorted(size.values())[-2] + 60_000
    assert not {500, 501, 502, None} & count.keys()


def test_record_stage(spark, folder, rows):
    docs = spark.createDataFrame(rows[0], KIND)
    back = binary_output.read_records(stage("token_records")(spark, docs, folder)).collect()
    plain = tokens.encoding(tokens.VOCABULARY)
    assert sorted((str(r["doc_id"]), r["tokens"]) for r in back) == sorted((str(r[1]), plain.encode_ordinary(r[2] or "")) for r in rows[0])


def test_the_whole_run(spark, folder, rows):
    manifest = P.run(spark, folder)
    kept = {r["doc_id"] for r in manifest.collect()}
    assert kept and None not in kept
    assert not kept & {200, 201, 202, 203, 500, 501, 502} and not kept & set(range(300, 312)) and not kept & set(range(400, 412))
    assert kept <= {r[1] for r in rows[0]}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
