import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trackloom.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i : i + 2])) for i in range(0, len(low), 2)])
    return levels


def climb(levels, at, node):
    """Siblings from position ``at`` up, and the root when the node there is another one."""
    others = []
    for level in levels[:-1]:
        other = level[at ^ 1] if at ^ 1 < len(level) else ""
        others.append(other)
        node = sha(other + node if at & 1 else node + other)
        at //= 2
    return "".join(others), node


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))

    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: plain_levels([leaf(r) for r in groups[name]]) for name in names}
    top = plain_levels([trees[name][-1][0] for name in names])
    out = []
    for g, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            doc, source, lang, n, text = row
            cut = zlib.crc32(str("" if doc is None else doc).encode()) % 7 == 0 and n is not None
            own = leaf((doc, source, lang, n + 1, text)) if cut else leaf(row)
            low, sub = climb(trees[name], i, own)
            high, root = climb(top, g, sub)
            out.append((doc, leaf(row), trees[name][-1][0], top[-1][0], sha(low + high), root, root == top[-1][0]))
    return sorted(out, key=repr)


def test_versions_share_what_they_do_not_change():
    leaves = [sha(str(i)) for i in range(11)]
    tree = merkle.build(leaves, 4)
    other = merkle.put(tree, 4, 10, sha("x"))

    def nodes(n):
        return {id(n): n} | (nodes(n[1]) if n[1] else {}) | (nodes(n[2]) if n[2] else {})

    first, second = nodes(tree), nodes(other)
    assert len(set(second) - set(first)) == 5  # the leaf and its four ancestors
    assert tree[0] == merkle.build(leaves, 4)[0]
    assert other[0] == merkle.build([*leaves[:10], sha("x")], 4)[0]
    for i in range(11):
        assert merkle.lift(leaves[i], merkle.path(tree, 4, i)) == tree[0]
        assert merkle.lift(sha("x"), merkle.path(tree, 4, i)) == merkle.put(tree, 4, i, sha("x"))[0]


def test_every_leaf_is_folded_over_its_own_siblings():
    leaves = [sha(str(i)) for i in range(5)]
    tree, above = merkle.build(leaves, 3), "r" + sha("beside") + "l" + sha("before")
    for i in range(5):
        steps = merkle.path(tree, 3, i) + above
        for other in (None, leaves[i], sha("x")):
            assert merkle.folded_root(tree, 3, i, other, steps) == merkle.lift(leaves[i] if other is None else other, steps)
        bad = steps[: -merkle.STEP] + "l" + sha("forged")
        assert merkle.folded_root(tree, 3, i, None, bad) != merkle.lift(leaves[i], steps)
    assert merkle.folded_root(tree, 3, 0, None, "r" + sha("forged") + merkle.path(tree, 3, 0)[merkle.STEP :]) != tree[0]


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_matches_plain_tree(spark, monkeypatch, bits):
    rng = random.Random(bits)
    langs = ["en"] * 6 + [None, "", "fr", "\u00e9", "z", "Z", "\U0001f600"]
    rows = [(i, rng.choice([None, "a", ""]), rng.choice(langs), rng.choice([None, 3, 99]), rng.choice(["t", None, "", "\u4e2d" * 9])) for i in range(150)]
    rows += [rows[3]] * 3 + [(None, None, "en", 1, "x")] * 2 + [(7, "other", "en", 1, "y"), (-5, "a", None, 2, "w" * 100000)]
    schema = "id bigint, src string, language string, size bigint, body string, hash string, lane string, place int, key string"
    frame = spark.createDataFrame([(*r, "?", "?", 0, "?") for r in rows], schema).repartition(5)
    own = merkle.leaf_hash("id", "src", "language", "size", "body")
    other = F.when(F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(7)) == 0, merkle.leaf_hash("id", "src", "language", F.col("size") + 1, "body"))
    found = merkle.manifest(frame, "language", "id", own, other, bits=bits)
    cut = found.select("key", "leaf", "subroot", "root", merkle.proof(F.col("steps")), "folded_root", F.col("folded_root") == F.col("root"))
    want = plain(rows)
    assert sorted((tuple(r) for r in cut.collect()), key=repr) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)
    if bits == 10:
        named = merkle.report(frame, "id", "src", "language", "size", "body")
        assert sorted((tuple(r) for r in named.collect()), key=repr) == want


def test_small_tables(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    assert merkle.report(spark.createDataFrame([], schema)).collect() == []
    for rows in ([(1, "s", "en", 2, "ab")], [(1, "s", "en", 2, "ab"), (2, None, None, None, None)]):
        got = merkle.report(spark.createDataFrame(rows, schema)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
