"""The prefix trie against plain Python on awkward conversations, in segments and in one."""

import collections
import hashlib
import random
import zlib

import pytest

from pyspark.sql import functions as F

from bindery.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, seg int, part string, n int, low long, token string"


def token(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()[:16] + len(text).to_bytes(4, "big"), role, text


def brute(rows, shared=True):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, *token(role, text)))
    plain = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9 if shared else 0
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(plain.get(base, [])[:h] + own[h:])
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    sums = collections.defaultdict(lambda: [0, 0])
    for node in members:
        for d in range(len(node) + 1):
            sums[node[:d]][0] += not children[node]
            sums[node[:d]][1] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (min(m), len(v), min(members[v[:-1]]) if v else -1, len(m), len(children[v]), *sums[v],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(v)))).encode()).hexdigest())
        for v, m in members.items()
    )


def found(spark, rows, parts=4, shared=True, **more):
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2, 3, "z") for r in rows], SCHEMA)
    if shared:
        more |= {"shares": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int"), "base": F.col("conv_id") - F.col("conv_id") % 5}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie.prefix_trie(frame, **more)
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        rows += [(c, t, rng.choice("ua"), rng.choice(["hi", "hello there", "ñ😀", ""])) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "u", f"same {t}") for c in range(100, 180) for t in range(6)]  # a group of copies
    rows += [(c, t, "u", f"same {t}") for c in range(180, 190) for t in range(c - 178)]  # its prefixes and longer ones
    rows += [(300, t, "u", "long") for t in range(40)] + [(301, t, "u", "long") for t in range(40)] + [(302, t, "u", "long" if t < 33 else "else") for t in range(50)]
    rows += [(None, 0, "u", "lost"), (400, None, None, None), (400, None, "u", None), (400, 3, None, "x"), (400, 3, None, "x"), (400, 3, "", "x"), (-7, 0, "u", "minus")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("parts", "segment"), [(4, trie.SEGMENT), (7, 3), (1, 8)])
def test_nodes_are_those_of_plain_python(spark, parts, segment):
    rows = conversations()
    assert found(spark, rows, parts, segment=segment) == brute(rows)


def test_without_shared_turns(spark):
    rows = conversations(2)
    assert found(spark, rows, 5, shared=False, segment=5) == brute(rows, shared=False)


def test_empty_tables_and_conversations_without_turns(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "u", "x")]) == []
    # Each loses its only turn, as none is given for it.
    bare = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9]
    rows = [(c, 0, "u", "x") for c in bare]
    ends = hashlib.sha256(",".join(map(str, bare)).encode()).hexdigest()
    assert found(spark, rows) == brute(rows) == [(bare[0], 0, -1, len(bare), 0, 1, 0, ends)]


def test_sweeps_of_any_cut_stitch_to_the_same_nodes():
    rng = random.Random(5)
    arrays = sorted({b"".join(bytes([rng.randrange(3)]) * 16 + (7).to_bytes(4, "big") for _ in range(rng.randrange(0, 7))) for _ in range(80)})
    items = [(0, 0, a, None, k, 1 + k % 3, 0, 0, 0) for k, a in enumerate(arrays)]

    def nodes(cuts):
        whole, parts = [], {}
        for a, b in zip([0, *cuts], [*cuts, len(items)]):
            for row in trie.sweep(iter(items[a:b]), 0):
                kind, id, parent, depth, low, n, size, children, leaves, saved, g1, g2, prefix = row
                if kind == trie.NODE:
                    whole.append(row[1:10])
                else:
                    was = parts.setdefault(id, [id, parent, depth, low, 0, size, 0, 0, 0, g1, g2, prefix])
                    was[3] = min((x for x in (was[3], low) if x is not None), default=None)
                    for at, more in zip((4, 6, 7, 8), (n, children, leaves, saved)):
                        was[at] += more
        return sorted(whole + [r[1:10] for r in trie.stitch(iter(sorted(parts.values(), key=lambda p: p[9:])), 0)])

    for cuts in ([], [1], [10, 11, 12], list(range(1, len(items)))):
        assert nodes(cuts) == nodes([40])
