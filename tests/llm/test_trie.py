"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gazeframe.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), tie, (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append((c, len(whole) == d))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c, end in sorted(held) if end)
        parent = min(members[node[:-1]])[0] if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(held)[0], len(node), parent, len(held), children[node], leaves[node], saved[node], digest))
    return sorted(out, key=repr)


def made(frame):
    assert frame.columns == COLUMNS
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def conversations(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        if rng.random() < 0.3:
            some = [("user", "the same"), ("assistant", "answer"), ("user", "again")]
        else:
            some = [(rng.choice(["user", "assistant", None]), rng.choice(words)) for _ in range(rng.randint(1, longest))]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(some)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns,rows", [(400_000, 65_536), (7, 3), (1, 1), (40, 1000)])
def test_trie_against_prefixes(spark, turns, rows):
    """Shards of any size, down to one row, recombine to the same nodes."""
    data = conversations(turns, 150, 6, ["a", "b", "é", "", None])
    frame = spark.createDataFrame(data, SCHEMA)
    assert made(trie.trie(frame, shard_turns=turns, shard_rows=rows)) == plain(data)


def test_long_conversations_use_further_matrices(spark):
    """Beginnings of more than two matrices' width that part late, and one that goes on from another's end."""
    rng = random.Random(5)
    base = [("user", rng.choice("xyz")) for _ in range(200)]
    data = []
    for c in range(0, 40, 5):
        some = base[: rng.choice([63, 64, 65, 128, 129, 150, 200])] + [("user", rng.choice("pq"))] * rng.randint(0, 3)
        data += [(c, t, *turn) for t, turn in enumerate(some)]
    want = plain(data)
    for turns in (400_000, 300):
        assert made(trie.trie(spark.createDataFrame(data, SCHEMA), shard_turns=turns)) == want


def test_one_conversation_shared_by_most(spark):
    """A sequence that most conversations have lies in many shards; its ends are hashed over all of them."""
    data = [(c, t, "user", f"t{t}") for c in range(2000) for t in range(2)] + [(5000, 0, "user", "t0")]
    assert made(trie.trie(spark.createDataFrame(data, SCHEMA).repartition(7), shard_rows=64)) == plain(data)


def test_odd_rows(spark):
    """NULLs in every column, ties and repeated rows, an empty text and a very long one, other columns."""
    data = [
        (None, 0, "user", "in no conversation"),
        (0, None, "user", "first"),
        (0, 0, None, None),
        (0, 0, "", ""),
        (0, 0, "user", "tie"),
        (0, 0, "user", "tie"),
        (1, 3, "user", "word " * 100_000),
        (2, 0, "us", "erx"),
        (3, 0, "user", "x"),
        (7, 0, "user", "first"),
    ]
    frame = spark.createDataFrame([(*r, 1, "k") for r in data], SCHEMA + ", depth int, key string")
    assert made(trie.trie(frame)) == plain(data)


def test_empty_table(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_reads_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert made(queries.QUERIES["op11_trie"](spark, sf)) == plain(rows)
