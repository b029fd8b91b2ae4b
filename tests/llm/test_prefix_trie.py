"""The prefix trie against brute force: hot conversations, long ones, ties, odd rows, small components."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from offerlake.llm import queries
from offerlake.llm.prefix_trie import PrefixTrie
from tests.llm.conftest import SMALL
from verify_checks import compare, database


def brute(conversations: dict[int, list[tuple[str, str]]]):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    totals = defaultdict(lambda: [0, 0])
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, inside in members.items():
        saved = (len(inside) - 1) * len(node[-1][1].encode()) if node else 0
        leaf = not any(len(conversations[c]) > len(node) for c in inside)
        for d in range(len(node) + 1):
            totals[node[:d]][0] += leaf
            totals[node[:d]][1] += saved
    out = set()
    for node, inside in members.items():
        ends = ",".join(map(str, sorted(c for c in inside if len(conversations[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(inside), len(node), parent, len(inside), children[node], *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def ordered(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in found.items()}


def shared(original):
    out = {}
    for c, turns in original.items():
        h = crc32(str(c).encode()) % 9
        out[c] = original.get(c - c % 5, [])[:h] + turns[h:]
    return out


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(3)
    rows = []
    for c in range(120):
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"text {rng.randrange(1 + t)}" if c % 3 else "same") for t in range(rng.randrange(1, 12))]
    rows += [(200, t, "user", f"long {t // 400}") for t in range(1500)]  # a conversation with a third of all rows
    rows += [(201, t, "user", f"long {t // 400}") for t in range(900)] + [(5000, 0, "user", "same"), (9001, 0, "user", "same")]
    rows += [(301, None, None, None), (301, None, None, None), (301, 3, "bot", "é" * 50), (302, 1, "b", "x"), (302, 1, "a", "y"), (302, 1, "a", "x"), (None, 0, "user", "gone"), (303, 0, "", "")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for name in ("conv", "i", "d", "part", "depth", "parent", "weight", "top", "node", "salt"):
        frame = frame.selectExpr("*", f"concat('{name}', conv_id) AS `{name}`")
    return rows, frame


@pytest.mark.parametrize("operator", [PrefixTrie(), PrefixTrie(small=150, chunk=3)])
def test_equals_brute_force(talks, operator):
    rows, frame = talks
    got = operator.with_shared_starts(frame).collect()
    assert {tuple(r) for r in got} == brute(shared(ordered(rows))) and len(got) == len(set(got))


def test_conversations_as_they_are(talks):
    rows, frame = talks
    got = PrefixTrie(small=400).of_conversations(frame).collect()
    assert {tuple(r) for r in got} == brute(ordered(rows))


def test_empty_table(talks):
    assert PrefixTrie().with_shared_starts(talks[1].limit(0)).collect() == []


def test_one_shape_of_everything(spark):
    same = spark.createDataFrame([(c, 0, "u", "hi") for c in range(0, 50, 5)] + [(c, 1, "u", "ho") for c in range(0, 50, 5)], "conv_id bigint, turn int, role string, text string")
    assert {tuple(r) for r in PrefixTrie(small=1, chunk=4).of_conversations(same).collect()} == brute({c: [("u", "hi"), ("u", "ho")] for c in range(0, 50, 5)})


def test_query_equals_sql(spark):
    name = "op12_prefix_trie"
    assert compare(queries.QUERIES[name](spark, SMALL), database(SMALL), queries.ORACLES[name]).startswith("ok")


def test_checks_see_the_shared_first_turns(spark):
    nodes = queries.QUERIES["op12_prefix_trie"](spark, SMALL)
    assert nodes.filter("depth > 0 AND n_convs > 1").count() > 0 and nodes.filter(F.col("depth") == 0).count() == 1
