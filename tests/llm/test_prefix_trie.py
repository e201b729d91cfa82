import hashlib
import random
import zlib
from collections import defaultdict

import odd
import pytest

from panelforge.llm import prefix_trie
from panelforge.llm.lcp_forest import Entry, Sequence, forest
from panelforge.llm.tables import read

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """conv_id to its rebuilt turns."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv_id].append((turn is not None, turn or 0, key, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        cut = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:cut] + turns[cut:]
    return out


def by_brute_force(rows):
    """All nodes from dictionaries of beginnings."""
    full = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        gain = (len(own) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += gain
            leaves[node[:d]] += children[node] == 0
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(full[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        counts = (len(own), children[node], leaves[node], saved[node], digest)
        out.append((min(own), len(node), parent, *counts))
    return odd.ordered(out)


def result(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves"]
    return odd.ordered(map(tuple, df.select(*names, "saved_tokens", "ends_sha256").collect()))


def odd_conversations(seed=1, n=60):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 7 == 3:
            continue
        for t in range(draw.choice([1, 2, 3, 9, 12, 14])):
            text = draw.choice(["yes", "no", "é" * 5, "", "日本"]) if t else "hello"
            rows.append((c, t, "user" if t % 2 == 0 else "bot", text))
    for c in (100, 101, 200, 201, 205, 300):  # equal ones, and one that goes on
        rows += [(c, t, "user", f"same {t}") for t in range(11 + (c == 201))]
    rows += [(400 + c, None, None, None) for c in range(3)]
    rows += [(500, 1, "a", "x"), (500, 1, "a", "x"), (500, 1, "b", None), (500, None, "a", "x")] * 4
    rows += [(-3, 0, "user", "hello"), (-5, 0, "user", "hello"), (-5, 1, "bot", "no")]
    rows += [(None, 0, "user", "nobody"), (600, 7, "a", "bc"), (601, 7, "ab", "c")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment", [4096, 5])
def test_odd_conversations(spark, segment):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(prefix_trie.trie(df, segment)) == by_brute_force(rows)


def test_smallest_table_with_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    df = read(spark, odd.SF, "conversations")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    assert result(prefix_trie.trie(df)) == by_brute_force(rows)


def test_extra_columns_and_empty_table(spark):
    names = "key, size, copies, before, level, s1, c1, run, side, part, kind, depth, base".split(", ")
    rows = odd_conversations(2, 12)
    wide = spark.createDataFrame(
        [(*r, *range(len(names))) for r in rows],
        SCHEMA + "".join(f", `{name}` int" for name in names),
    )
    assert result(prefix_trie.trie(wide)) == by_brute_force(rows)
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversation_and_long_digest(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    rows = [(5, t, "user", f"t{t // 3}") for t in range(700)]
    rows += [(9, t, "user", f"t{t // 3}") for t in range(520)]
    rows += [(c, 0, "user", "hi") for c in range(1000, 1090)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(prefix_trie.trie(df, 64)) == by_brute_force(rows)


def nodes_of(strings, cuts, fan):
    """Nodes of sorted strings, cut into runs that are merged ``fan`` at a time."""
    made, names, roots = [], {}, []

    def keep(found):
        made.extend(found.nodes)
        roots.extend(found.roots)
        names.update({(run, side, depth): name for run, side, depth, name in found.names})
        return found.ends

    def sequence(k, text):
        keys = b"".join(c.encode() * 16 for c in text)
        sizes = [ord(c) for c in text]
        return Sequence((0, 0), keys, sizes, {len(text): Entry(1, k, ends=text or "-")})

    items = [sequence(k, text) for k, text in strings]
    bounds = [0, *cuts, len(items)]
    runs = [items[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    level = 0
    while len(runs) > 1:
        ends = [keep(forest(r, f"{level}-{k}", False, True)) for k, r in enumerate(runs)]
        runs = [sum(ends[k : k + fan], []) for k in range(0, len(ends), fan)]
        level += 1
    assert keep(forest(runs[0], "last", True, True)) == [] and roots == []
    for node in made:
        if node[8] is not None:
            node[2] = names[node[8], node[9], node[1] - 1]
    return odd.ordered(tuple(node[:8]) for node in made)


def test_cuts_change_no_node():
    draw = random.Random(8)
    for _ in range(150):
        texts = {"".join(draw.choices("ab", k=draw.randrange(7))) for _ in range(14)}
        ids = list(range(len(texts)))
        draw.shuffle(ids)
        strings = list(zip(ids, sorted(texts), strict=True))
        wanted = nodes_of(strings, [], 2)
        assert len(wanted) == len({t[:d] for t in texts for d in range(len(t) + 1)})
        for fan in (2, 3):
            cuts = sorted(draw.sample(range(1, max(2, len(strings))), min(5, len(strings) - 1)))
            assert nodes_of(strings, cuts, fan) == wanted
