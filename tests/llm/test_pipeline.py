"""The pipeline against a plain reading of each stage's own operator and of its input."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
import corpus_pipeline
from tarnwatch.llm import pieces
from tarnwatch.session import stage

SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], sf_dir), "test-stage"))
    return out


def test_stages_keep_the_columns(staged):
    assert [s.columns for s in staged[1:-1]] == [staged[0].columns] * 4


def test_filters_only_drop_rows(staged):
    rows = [Counter(tuple(r) for r in s.collect()) for s in staged[:4]]
    assert all(not after - before for before, after in zip(rows, rows[1:]))


def test_one_of_equal_texts_stays(staged):
    before, after = (defaultdict(list) for _ in range(2))
    for kept, s in ((before, staged[1]), (after, staged[2])):
        for r in s.collect():
            kept[SPACES.sub("", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
    assert {k: [min(v)] for k, v in before.items()} == dict(after)


def test_one_of_similar_texts_stays(staged):
    sets = {}
    for r in staged[2].collect():
        words = WORD.findall(r["text"].lower() if r["text"].isascii() else r["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        size = min(5, len(words))
        sets[r["doc_id"]] = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()
    ids, label = sorted(sets), {i: i for i in sets}
    links = [(i, j) for i in ids for j in ids if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= (label[i], label[j]) != (low, low)
            label[i] = label[j] = low
    assert {r["doc_id"] for r in staged[3].collect()} == {i for i in ids if label[i] == i}


def test_the_mix_has_half_as_many_words_again(staged):
    words = [sum(len(WORD.findall(r["text"])) for r in s.collect()) for s in staged[3:5]]
    assert abs(words[1] - 1.5 * words[0]) < 0.02 * words[0]


def test_every_document_of_the_mix_is_encoded(staged):
    assert Counter(r["doc_id"] for r in staged[5].collect()) == Counter(r["doc_id"] for r in staged[4].collect())
    assert staged[5].where("NOT round_trip").count() == 0


def test_every_document_has_all_its_segmentations(spark, sf_dir):
    texts = ["some words of a text", "x", "", None]
    docs = stage(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "test-stage")
    plain = defaultdict(list)
    for r in pieces.sampled_pieces(docs, with_ids=True).orderBy("doc_id", "sample").collect():
        plain[r["doc_id"]].append(tuple(r)[1:])
    found = corpus_pipeline.encode(spark, docs, sf_dir).collect()
    assert {r["doc_id"]: [tuple(r)[1:-1], *map(tuple, r["others"])] for r in found} == dict(plain)
    rows = {r["doc_id"]: r for r in found}
    assert len(found) == 4 and len(rows[0]["others"]) == pieces.SAMPLES - 1
    assert len({tuple(ids) for ids in (rows[0]["ids"], *(o["ids"] for o in rows[0]["others"]))}) == pieces.SAMPLES
    assert (rows[2]["n_pieces"], rows[2]["others"], rows[3]["others"]) == (0, [], [])


def test_run_gives_the_last_stage(spark, sf_dir, staged):
    found = spark_entry.queries()["pipeline"](spark, sf_dir)
    assert sorted(map(str, found.collect())) == sorted(map(str, staged[5].collect()))


def test_repeated_and_null_ids_are_told_apart(spark, sf_dir):
    copy, near, other = ("word%d " * 40 % tuple(range(k, k + 40)) for k in (0, 0, 500))
    near += "end"
    rows = [(1, copy), (1, other), (2, copy.replace(" ", "  ")), (2, other + "more"), (None, copy), (None, "alone"), (None, "twice"), (None, "twice"),
            (3, "same"), (3, "same"), (3, None), (4, ""), (5, "un fin")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], schema).repartition(3)
    found = Counter(tuple(r)[:2] for r in corpus_pipeline.drop_copies(spark, frame, sf_dir).collect())
    assert found - Counter({(3, None): 1}) == Counter([(2, copy.replace(" ", "  ")), (1, other), (2, other + "more"), (None, "alone"), (None, "twice"), (3, "same"), (5, "un fin")])
    assert found[3, None] == 1

    rows = [(1, copy), (1, near), (2, near + " of it"), (2, "only here"), (None, copy + "x"), (None, other), (None, other + "y"), (None, "alone"), (7, "same"), (7, "same"), (8, None), (8, "")]
    frame = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], schema).repartition(3)
    found = Counter(tuple(r)[:2] for r in corpus_pipeline.drop_near_copies(spark, frame, sf_dir).collect())
    big = [k for k in found if k[0] == 1]
    none = [k for k in found if k[0] is None and k[1].startswith(other)]
    assert [len(big), len(none), found[(big or [0])[0]], found[(none or [0])[0]]] == [1, 1, 1, 1]
    assert found - Counter(big + none) == Counter([(2, "only here"), (None, "alone"), (7, "same"), (8, None), (8, "")])


def test_columns_of_the_input_may_have_any_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    docs = stage(docs.unionByName(docs.where("doc_id < 9")), "test-stage")
    names = ["row_key", "row", "id", "key", "best", "points", "passes", "parts", "_words", "_id", "_size", "_nth", "_nth_row", "_text", "_partial", "component", "kept"]
    strange = stage(docs.select("*", *(F.concat(F.lit(f"{c}/"), F.col("doc_id").cast("string")).alias(c) for c in names)), "test-stage")
    for _, function in corpus_pipeline.STAGES[:4]:
        plain, found = function(spark, docs, sf_dir), function(spark, strange, sf_dir)
        assert found.columns == strange.columns
        rows = found.collect()
        assert all(r[c] == f"{c}/{r['doc_id']}" for r in rows for c in names)
        assert Counter(tuple(r)[:len(docs.columns)] for r in rows) == Counter(map(tuple, plain.collect()))
