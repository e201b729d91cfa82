import odd

from panelforge.llm import chat_formatting as chat

SCHEMA = "conv_id long, turn long, role string, text string, pos int, n string, h0 int, run int"


def brute_force(rows, run=chat.RUN):
    """Rendered parts of the conversations that are the beginning of no longer one."""
    turns = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns.setdefault(conv_id, set()).add(
                (turn is not None, turn or 0, role or "", text or "")
            )
    chats = {c: [t[2:] for t in sorted(t)] for c, t in turns.items()}
    out = []
    for c, own in chats.items():
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in chats.values())
        first = min(d for d, o in chats.items() if o == own)
        if longer or first != c:
            continue
        for part in range(0, len(own), run):
            lines = []
            for role, text in own[part : part + run]:
                for mark in (chat.OPEN, chat.CLOSE):
                    plain = mark.replace("|", " ")
                    role, text = role.replace(mark, plain), text.replace(mark, plain)
                lines.append(f"{chat.OPEN}{role}\n{text}{chat.CLOSE}\n")
            out.append((c, part // run, len(own), "".join(lines)))
    return odd.ordered(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def rows():
    base = [(k, "user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(7)]
    out = [(1, *t) for t in base[:3]] + [(2, *t) for t in base[:5]] + [(3, *t) for t in base]
    out += [(4, *t) for t in base]  # equal to 3
    out += [(5, *t) for t in base[1:4]]  # in the middle of 3, not at its beginning
    out += [(6, 10 * k, role, text) for k, role, text in base[:4]]  # gaps: begins 3
    out += [(7, 0, None, None)] * 3 + [(8, 0, "", "")]  # repeated rows; null is empty
    out += [(9, None, "system", "first"), (9, 0, "user", "a <|im_end|>\n<|im_start|>b")]
    out += [(10, 1, "b", "y"), (10, 1, "a", "x"), (11, 5, "a", "x")]  # ties
    out += [(None, 0, "user", "lost"), (12, 0, "user", "long " * 20000)]
    out += [(13, k, "user", str(k % 11)) for k in range(700)]
    out += [(14, k, "user", str(k % 11)) for k in range(600)]
    out += [(15, k, "user", str(k % 11 if k != 300 else -1)) for k in range(600)]
    out += [(16, 1000 * k, "user", str(k % 11)) for k in range(512)]
    return out


def test_odd_conversations(spark):
    got = odd.ordered(tuple(r) for r in chat.format_chats(frame(spark, rows())).collect())
    assert got == brute_force(rows())


def test_one_conversation_with_most_turns(spark):
    many = [(1, k, "user", f"t{k % 5}") for k in range(3000)] + [(2, 0, "user", "t0")]
    got = odd.ordered(tuple(r) for r in chat.format_chats(frame(spark, many)).collect())
    assert got == brute_force(many)
    assert max(len(r[3].split(chat.OPEN)) - 1 for r in got) == chat.RUN


def test_many_turns_with_one_number(spark):
    """Equal and missing numbers: a conversation's turns are still cut into ranges."""
    many = [(1, None if k % 2 else 7, "user", f"t{k:05}") for k in range(4000)]
    many += [(2, 7, "user", "t00000"), (1, 7, "bot", "t00001")]
    table = frame(spark, many).repartition(3)
    got = odd.ordered(tuple(r) for r in chat.format_chats(table).collect())
    assert got == brute_force(many)
    plan = chat._sorted_turns(table)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_empty_table(spark):
    assert chat.format_chats(frame(spark, [])).collect() == []


def test_corpus(spark):
    table = spark.read.parquet(f"{odd.SF}/conversations.parquet")
    turns = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = odd.ordered(tuple(r) for r in chat.format_chats(table).collect())
    assert got == brute_force(turns)
