"""Spelling variants, shards and the Merkle manifest against plain Python."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.llm import merkle, queries, ranks, shards, spelling

CLASHING = ["pos", "shard", "slot", "row", "key", "node", "group", "weight", "word", "n", "root", "steps", "id", "size"]
TEXT_ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    letters = "abcdefgé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(30)]
    variants = [w[:i] + rng.choice(["", "x", w[i] + "é", "a"]) + w[i + 1:] for w in base for i in (0, len(w) // 2, len(w) - 1)]
    texts = [" ".join(rng.choice(base if rng.random() < 0.8 else variants) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    long = "q" * 3000
    texts += [None, "", " \n", "line\nline", "Straße Straße\nnaïve", long + " " + long[1:] + " " + long + "z", "ÀÉÎÕÜ×ab", "aaaaaa aaaaaaa aaaaab " * 9]
    texts += ["copy of one text\nagain"] * 25 + [texts[-3]] * 6
    out = [(i, t, ["en", None][i % 2], ["a", "b", None, "é", "é"][i % 5], len(t) if t is not None else None) for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, "lost\nid", "en", "a", 7), (None, None, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame(rows, TEXT_ROWS)


@pytest.fixture(scope="module")
def empty(documents):
    return documents.where("false")


@pytest.fixture(scope="module")
def folder(tmp_path_factory, documents):
    path = tmp_path_factory.mktemp("odd")
    documents.withColumn("extra", F.lit(1)).repartition(5).write.parquet(f"{path}/documents.parquet")
    documents.where("false").write.parquet(f"{path}/none/documents.parquet")
    return str(path)


# places


def test_places_are_gapless_whatever_the_key(spark, rows):
    rng = random.Random(1)
    data = [(rng.choice(["hot", "hot", None, "b", "c"]), rng.randrange(20), i) for i in range(3000)]
    frame = spark.createDataFrame(data, "key string, v int, i int").repartition(7)
    found = defaultdict(list)
    for r in ranks.ranked(frame, "key", [F.desc("v")], "places").collect():
        found[r["key"]].append((r["pos"], r["key_rows"], r["v"]))
    for key, members in found.items():
        values = sorted((v for k, v, _ in data if k == key), reverse=True)
        members.sort()
        assert [m[0] for m in members] == list(range(len(values))) and {m[1] for m in members} == {len(values)}
        assert [m[2] for m in members] == values
    assert ranks.ranked(frame.where("false"), "key", [], "places").count() == 0


# spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in spelling.RUN.findall(lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_variants(words, ratio=5):
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    out, form = {}, {}
    for w, n in words.items():
        close = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_length[size] if v != w and near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = (n, len(close), words[form[w]] if form[w] else None)
    root = {}
    for w in words:
        last = w
        while form[last]:
            last = form[last]
        root[w] = last
    return {(w, form[w], root[w], *out[w]) for w in words}


def variant_rows(frame):
    found = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_variants_match_brute_force(documents, rows):
    expected = brute_variants(brute_words(rows))
    assert sum(r[1] is not None for r in expected) > 3 and any(len(r[0]) > 2000 for r in expected)
    assert variant_rows(spelling.spelling_variants(documents)) == expected


@pytest.mark.parametrize("symbols", [1, 2, 6, 40])
def test_near_words_are_complete_for_any_alphabet(spark, symbols):
    rng = random.Random(symbols)
    words = {"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))): rng.randrange(1, 999) for _ in range(400)}
    words |= {"a": 3, "aa": 3, "z" * 200: 1, "z" * 201: 9, "z" * 100 + "y" + "z" * 100: 2}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = [(r["word"], r["near"]) for r in spelling.near_words(frame, symbols).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if a != b and near(a, b)}


def test_slices_of_a_word_give_the_same_keys(monkeypatch):
    words = ["abcdefghij", "b", "zzzzzzzzzzzz"]
    whole = {(int(r), int(k)) for rows, keys in spelling.neighbour_keys(words) for r, k in zip(rows, keys)}
    monkeypatch.setattr(spelling, "SLICE", 3)
    assert {(int(r), int(k)) for rows, keys in spelling.neighbour_keys(words) for r, k in zip(rows, keys)} == whole


def test_forms_are_followed_to_the_last(spark):
    words = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125), ("abbbbb", 15625), ("cccccc", 5), ("cccccd", 24), ("eeeeee", 5), ("eeeeef", 25), ("eeeeeg", 25)]
    found = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert found["aaaaaa"] == ("aaaaab", "abbbbb") and found["abbbbb"] == (None, "abbbbb")
    assert found["cccccc"] == (None, "cccccc") and found["eeeeee"] == ("eeeeef", "eeeeef")


def test_variants_query_over_the_table(spark, sf_dir, folder, rows):
    assert variant_rows(queries.op11_reduced_alphabet_variants(spark, folder)) == brute_variants(brute_words(rows))
    assert queries.op11_reduced_alphabet_variants(spark, f"{folder}/none").count() == 0
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert variant_rows(queries.op11_reduced_alphabet_variants(spark, sf_dir)) == brute_variants(brute_words(table))


# shards


def brute_lpt(weights, shards_):
    heap, out = [(0, s) for s in range(shards_)], Counter()
    for w in sorted(weights, reverse=True):
        load, shard = heapq.heappop(heap)
        out[w, shard] += 1
        heapq.heappush(heap, (load + w, shard))
    return out, sorted((s, load) for load, s in heap)


def test_runs_are_dealt_as_group_by_group():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.choice([1, 2, 8])
        loads = [rng.randrange(0, 400) for _ in range(n)]
        weight, count = rng.randrange(1, 60), rng.randrange(0, 300)
        heap, expected = [(load, s) for s, load in enumerate(loads)], [0] * n
        heapq.heapify(heap)
        for _ in range(count):
            load, s = heapq.heappop(heap)
            expected[s] += 1
            heapq.heappush(heap, (load + weight, s))
        assert shards.deal(loads, weight, count) == expected
        assert sorted((load, s) for s, load in enumerate(loads)) == sorted(heap)


@pytest.mark.parametrize("n_shards", [1, 3, 8])
def test_groups_are_scheduled_longest_first(spark, n_shards):
    rng = random.Random(n_shards)
    weights = {f"g{i}": rng.choice([1, 1, 1, 2, 7, 7, rng.randrange(1, 500)]) for i in range(700)} | {"giant": 20_000, None: 13}
    parts = [(g, p) for g, w in weights.items() for p in ((w // 2, w - w // 2) if w > 1 else (w,))]
    frame = spark.createDataFrame(parts, "group string, size long").repartition(6)
    found = shards.group_shards(frame, n_shards).collect()
    assert Counter(r["group"] for r in found) == Counter(list(weights))
    expected, loads = brute_lpt(weights.values(), n_shards)
    assert Counter((weights[r["group"]], r["shard"]) for r in found) == expected
    best = max(max(weights.values()), -(-sum(weights.values()) // n_shards))
    assert max(load for _, load in loads) <= best * 4 / 3


def check_shards(found, rows):
    assert len(found) == len(rows)
    slots, of_text, size = defaultdict(list), defaultdict(set), Counter()
    for r in found:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    for taken in slots.values():
        assert sorted(taken) == list(range(len(taken)))
    texts = defaultdict(list)
    for doc_id, text, *_ in rows:
        texts[doc_id].append(text or "")
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    for r in found:
        of_text[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())
    groups = Counter()
    for _, text, *_ in rows:
        groups[text or ""] += len((text or "").encode()) + 1
    assert dict(brute_lpt(groups.values(), 8)[1]) == {s: size[s] for s in range(8)}
    assert {r["law"] for r in found} <= {"bytes"} and {r["grown_shard"] for r in found} <= {None}


def test_shards_query_over_the_tables(spark, sf_dir, folder, rows):
    check_shards(queries.op12_lpt_shards(spark, folder).collect(), rows)
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op12_lpt_shards(spark, sf_dir).collect()
    check_shards(found, table)
    assert sorted(map(str, found)) == sorted(map(str, queries.op12_lpt_shards(spark, sf_dir).collect()))
    assert queries.op12_lpt_shards(spark, f"{folder}/none").count() == 0


def test_shards_keep_all_columns_and_are_written(documents, rows, tmp_path):
    clashing = documents.select("*", *(F.lit("clash").alias(c) for c in CLASHING))
    sharded = shards.lpt_shards(clashing, F.col("source"), F.coalesce("n_chars", F.lit(0)) + 1, 4)
    assert sharded.columns == [c for c in clashing.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    found = sharded.collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in found) == Counter((i, t, s) for i, t, _, s, _ in rows)
    assert {r["row"] for r in found} == {"clash"} and len({r["shard"] for r in found}) <= 4
    written = {r["shard"]: r["rows"] for r in shards.write_shards(sharded, str(tmp_path / "out"), 20).collect()}
    assert written == Counter(r["shard"] for r in found)


# manifest


def brute_tree(nodes, arity=3):
    """Steps (left, right) of every node, and the top."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(steps)):
            a = at[i] // arity * arity
            run = nodes[a:a + arity]
            steps[i].append(("".join(run[:at[i] - a]), "".join(run[at[i] - a + 1:])))
            at[i] //= arity
        nodes = [sha("".join(nodes[a:a + arity])) for a in range(0, len(nodes), arity)]
    return steps, (nodes[0] if nodes else None)


def brute_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_manifest(rows):
    sources = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        node = brute_leaf(doc_id, source, lang, n_chars, text)
        found = brute_leaf(doc_id, source, lang, n_chars, text.replace("\n", "")) if tampered else node
        sources[source].append((doc_id is not None, doc_id or 0, node, found))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort()
        trees[s] = brute_tree([m[2] for m in sources[s]])
    tops, root = brute_tree([trees[s][1] for s in order])
    out = Counter()
    for s, top in zip(order, tops):
        for (known, doc_id, node, found), steps in zip(sources[s], trees[s][0]):
            proof, folded = "".join(a + b for a, b in steps + top), found
            for a, b in steps + top:
                folded = sha(a + folded + b)
            out[(doc_id if known else None, node, trees[s][1], root, sha(proof), folded, folded == root)] += 1
    return out


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_query_matches_brute_force(spark, sf_dir, folder, rows):
    found = Counter(tuple(r[c] for c in MANIFEST) for r in queries.op13_lag_lead_merkle(spark, folder).collect())
    expected = brute_manifest(rows)
    assert found == expected
    assert {k[-1] for k in expected} == {True, False}
    assert queries.op13_lag_lead_merkle(spark, f"{folder}/none").count() == 0
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert Counter(tuple(r[c] for c in MANIFEST) for r in queries.op13_lag_lead_merkle(spark, sf_dir).collect()) == brute_manifest(table)


@pytest.mark.parametrize("levels,arity", [(1, 3), (2, 3), (2, 2), (1, 5)])
def test_rounds_of_any_height_give_the_same_tree(spark, levels, arity):
    sizes = {None: 1, "a": 2, "b": arity, "c": arity**2 + 1, "d": arity**3, "e": arity**3 + arity + 1}
    leaves = [(key, sha(f"{key}{i:05d}"), i) for key, size in sizes.items() for i in range(size)]
    frame = spark.createDataFrame(leaves, "key string, node string, i int").repartition(5)
    found = {(r["key"], r["i"]): r for r in merkle.manifest(frame, [F.col("i")], levels, arity).collect()}
    assert len(found) == len(leaves)
    trees = {key: brute_tree([sha(f"{key}{i:05d}") for i in range(size)], arity) for key, size in sizes.items()}
    tops, root = brute_tree([trees[key][1] for key in sizes], arity)
    for (key, i), r in found.items():
        steps = trees[key][0][i] + tops[list(sizes).index(key)]
        assert [(s["left"], s["right"]) for s in r["steps"]] == steps
        assert (r["pos"], r["subroot"], r["root"]) == (i, trees[key][1], root)


def test_manifest_passes_columns_on(documents):
    clashing = documents.select("doc_id", *(F.lit("clash").alias(c) for c in CLASHING if c not in ("key", "node")), F.col("source").alias("key"), merkle.leaf(F.col("text")).alias("node"))
    proven = merkle.manifest(clashing, [F.col("doc_id")])
    assert sorted(proven.columns) == sorted({*clashing.columns, "pos", "subroot", "root", "steps"})
    found = proven.collect()
    assert len(found) == documents.count() and {r["word"] for r in found} == {"clash"}
    assert len({r["root"] for r in found}) == 1
