import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from parcelspark.llm import conversation_trie as trie

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuild(rows, family=5, most=9):
    """Rebuilt sequences of (role, text) by conversation, as the contract says."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            tie = hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, tie), (r, t)))
    seq = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in seq.items():
        first = c - (abs(c) % family if c >= 0 else -(abs(c) % family))
        h = zlib.crc32(str(c).encode()) % most
        out[c] = seq.get(first, [])[:h] + v[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    saved, leaves, out = defaultdict(int), defaultdict(int), []
    for k in sorted(members, key=len, reverse=True):
        saved[k] += (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        leaves[k] += not kids[k]
        if k:
            saved[k[:-1]] += saved[k]
            leaves[k[:-1]] += leaves[k]
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, depth int").repartition(3)


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_equals_brute_force(spark, block):
    rnd = random.Random(block)
    rows = []
    for c in [*range(60), *range(100, 160, 3), -7, -10, -1]:
        for t in range(rnd.randrange(1, 14)):
            rows.append((c, rnd.choice([t, t, t, None, 3]), rnd.choice(["user", "bot", None]), rnd.choice(["a", "é", None, "", "b"])))
    rows += [(5, 1, "user", "a")] * 4 + [(None, 1, "user", "a"), (41, None, None, None)]
    members, turns = trie.rebuilt(trie.numbered(table(spark, rows)))
    got = sorted(map(tuple, trie.prefix_trie(members, turns, block, 8).collect()), key=repr)
    assert got == brute(rebuild(rows))


def test_hot_prefixes_and_a_very_long_conversation(spark):
    """A third of the conversations alike, one first turn for most, one conversation with most turns, in small parts."""
    rows = [(c, t, "user", "hello") for c in range(0, 900, 5) for t in range(3)]
    rows += [(c, t, "user", "hello" if t < 1 else f"{c % 7} {t}") for c in range(1000, 1200, 5) for t in range(4)]
    rows += [(2000, t, "user", f"turn {t % 11}") for t in range(1500)] + [(2003, t, "user", f"turn {t % 11}") for t in range(1400)]
    members, turns = trie.rebuilt(trie.numbered(table(spark, rows)))
    got = sorted(map(tuple, trie.prefix_trie(members, turns, 64, 40).collect()), key=repr)
    assert got == brute(rebuild(rows))


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "lost"), (c + 500 - c % 5, 0, "a", "b")]
    got = sorted(map(tuple, trie.conversation_trie(table(spark, rows)).collect()), key=repr)
    assert got == brute(rebuild(rows)) and got[0][3] == 2 and got[0][7] == hashlib.sha256(str(c).encode()).hexdigest()


def test_only_turnless_and_empty_tables(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    got = trie.conversation_trie(table(spark, [(c, 0, "user", "lost")])).collect()
    assert [tuple(r)[:7] for r in got] == [(c, 0, None, 1, 0, 1, 0)] and got[0].asDict().keys() == set(COLS)
    assert trie.conversation_trie(table(spark, [(c, 0, "a", "b")]).where("false")).count() == 0
    assert trie.conversation_trie(table(spark, [(None, 0, "a", "b")])).count() == 0


def test_very_long_texts(spark):
    rows = [(0, 0, "u", "é" * 1_000_000), (5, 0, "u", "é" * 1_000_000), (10, 0, "u", "x")]
    got = sorted(map(tuple, trie.conversation_trie(table(spark, rows)).collect()), key=repr)
    assert got == brute(rebuild(rows)) and max(r[6] for r in got) == 2_000_000
