import math
import zlib
from collections import Counter

import xxhash

from timbre.llm import sharding

ROWS = [(i if i % 11 else None, [None, "", "tie", "long " * 2000, "é"][i % 5], 1, "x") for i in range(900)] + [(7, "tie", 1, "x")] * 40
TREE = sharding.even_tree(8)


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string").repartition(5)


def draw(doc_id, path, weight):
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(str(doc_id).encode(), 42)
    return -math.log(((xxhash.xxh64_intdigest(path.encode(), seed) >> 11) + 0.5) / 2**53) / weight


def brute(doc_id, tree, path=""):
    if not isinstance(tree, dict):
        return None
    weight = lambda x: sum(map(weight, x.values())) if isinstance(x, dict) else x
    child = min(tree, key=lambda c: draw(doc_id, f"{path}/{c}", weight(tree[c])))
    return brute(doc_id, tree[child], f"{path}/{child}") if isinstance(tree[child], dict) else child


def test_equals_brute_force_with_gapless_slots(spark):
    more = sharding.grown(TREE, 8)
    got = sharding.shard(docs(spark), TREE, more).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    slots = {}
    for r in got:
        assert r.shard == brute(r.doc_id, TREE) and r.grown_shard == brute(r.doc_id, more) and r.law == "key"
        assert r.grown_shard in (8, r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard(docs(spark, []), TREE, more).count() == 0


def test_shares_follow_weights_and_moves_stay_in_changed_subtrees(spark):
    ids = spark.range(20_000).selectExpr("id as doc_id", "'' as text")
    tree = {"a": {"r": {0: 1.0, 1: 3.0}, "s": {2: 2.0}}, "b": {"r": {3: 2.0, 4: 0.0}}, "c": {"r": {5: 2.0}}}
    heavier = {**tree, "a": {**tree["a"], "s": {2: 4.0}}}
    rows = [(r.shard, r.grown_shard) for r in sharding.shard(ids, tree, heavier).collect()]
    n = Counter(a for a, _ in rows)
    assert n[4] == 0 and all(abs(n[k] - 2000 * w) < 300 for k, w in {0: 1, 1: 3, 2: 2, 3: 2, 5: 2}.items())
    moved = Counter((a, b) for a, b in rows if a != b)
    assert moved and all(b in (0, 1, 2) for _, b in moved) and not any({a, b} == {3, 5} for a, b in moved)


def test_ids_of_any_width_agree(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(50)], "doc_id long, text string")
    tree = sharding.even_tree(8)
    wide, narrow = ({r.doc_id: r.shard for r in sharding.shard(d, tree, tree).collect()} for d in (docs, docs.selectExpr("cast(doc_id as int) as doc_id", "text")))
    assert wide == narrow and len(set(wide.values())) == 8
