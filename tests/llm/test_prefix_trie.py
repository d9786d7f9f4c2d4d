"""The prefix trie against a plain Python one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from seriesgrove.llm import prefix_trie
from seriesgrove.llm.common import new_folder

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends) by walking a trie of dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in own.items()}
    made = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in sorted(made.items()):
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * words(node) + sum(saved[k] for k in kids[node])
    return sorted(
        (m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(",".join(str(c) for c in m if len(made[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items()
    )


def stored(spark, rows):
    path = new_folder(spark, "test")
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def found(spark, rows, **options):
    return sorted(tuple(r) for r in prefix_trie.trie(spark, stored(spark, rows), **options).collect())


def sample(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for c in convs:
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"t{rng.randrange(2)} word" + " x" * rng.randrange(2)))
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 2, "heavy": 8, "chunk": 3}])
def test_equals_brute_force(spark, options):
    rows = sample(1, [*range(0, 70), *range(1000, 1040), -40, -39, -21, -20, -7], 7)
    hot = [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(12)]  # equal conversations
    odd = [(9, None, None, None), (9, None, "user", None), (9, 3, "user", "tie b"), (9, 3, "user", "tie a"), (9, 3, "user", "tie a"), (61, 0, "", ""), (None, 1, "user", "nobody"), (5000, 0, "user", "x y  z\n"),
           (71, 0, "us", "er"), (72, 0, "user", "")]
    long = [(300, t, "user", f"long {t % 3}") for t in range(700)] + [(301, t, "user", f"long {t % 3}" if t < 600 else "other") for t in range(650)]
    rows += hot + odd + long
    random.Random(2).shuffle(rows)
    assert found(spark, rows, **options) == brute(rows)


def test_huge_turn_and_empty_table(spark):
    rows = [(20, 0, "user", "w " * 200_000), (21, 0, "user", "q"), (21, 1, "user", "w " * 200_000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, None, None, None)]) == []


def test_hand_made(spark):
    rows = [(0, 0, "user", "hello there"), (0, 1, "assistant", "hi"), (0, 2, "user", "bye"), (400, 0, "user", "one")]
    nodes = {(r[0], r[1]): r for r in found(spark, rows)}
    assert nodes[0, 0][3] == 2 and nodes[0, 0][2] is None
    assert nodes[0, 3][2] == 0 and nodes[0, 3][4] == 0 and nodes[0, 3][5] == 1
