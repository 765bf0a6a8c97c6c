"""Quotation linking beside a brute-force linker, on generated conversations."""

import itertools
import random
import re
import time

import duckdb

from marketloom.llm import chat

SENTENCES = [f"{a} {b} is {c}" for a in ("The red", "Some", "No") for b in ("house", "tree", "river", "road") for c in ("old", "here", "gone", "too far")]


def written(rng):
    """One to three paragraphs of sentences, some wrapped."""
    paragraphs = [" ".join(rng.choice(SENTENCES) + rng.choice(".!?") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))]
    return [re.sub(" is ", "\nis ", p, count=1) if rng.random() < 0.3 else p for p in paragraphs]


def quoted(rng, paragraph, level):
    """The paragraph as a mail program quotes it: whole, wrapped anew, or a sentence out of it, in other case and spacing."""
    way = rng.random()
    if way < 0.3:
        lines = paragraph.split("\n")
    elif way < 0.6:
        words = paragraph.split()
        lines = [" ".join(words[i : i + 4]) for i in range(0, len(words), 4)]
    else:
        lines = [rng.choice(re.split(r"(?<=[.!?])\s+", paragraph.replace("\n", " ")))]
    if rng.random() < 0.3:
        lines = [line.upper().replace(" ", "  ") for line in lines]
    return "\n".join(rng.choice((">", "> ")) * level + rng.choice(("", " ")) + line for line in lines)


def conversations(seed, number=12):
    rng = random.Random(seed)
    rows = []
    for conv in range(number):
        past = []
        for turn in range(rng.randint(1, 9)):
            parts = written(rng)
            own = list(parts)
            for _ in range(rng.choice((0, 0, 1, 2)) if past else 0):
                parts.insert(rng.randint(0, len(parts)), quoted(rng, rng.choice(past), rng.choice((1, 1, 2, 3))))
            if rng.random() < 0.1:
                parts.insert(0, "> nobody ever wrote this. Nor this")
            rows.append((conv, turn, "user", rng.choice(("\n\n", "\n", "\r\n\r\n")).join(parts)))
            past += own
    return rows


def pieces_of(text):
    """{(level, passage): pieces} by plain Python."""
    found = {}
    lines = []
    for line in re.split(r"\r\n|\r|\n", text or ""):
        marks = re.match(r"\s{0,3}((?:>\s?)+)", line)
        lines.append((marks.group(1).count(">"), line[marks.end() :]) if marks else (0, line))
    normal = lambda body: " ".join(re.findall(r"[^\W_]+", body.lower()))
    for (blank, level), run in itertools.groupby(lines, key=lambda x: (not x[1].strip(), x[0])):
        if blank:
            continue
        run = [body for _, body in run]
        whole = " ".join(run)
        parts = {normal(p) for p in [whole, *run, *re.split(r"(?<=[.!?])\s+", whole)]} - {""}
        if parts:
            found.setdefault((level, normal(whole)), set()).update(parts)
    return found


def brute_links(rows):
    known = {(conv, turn): pieces_of(text) for conv, turn, _, text in rows}
    links, out = {}, []
    for conv, turn in sorted(known):
        passages = {k: v for k, v in known[conv, turn].items() if k[0] > 0}
        origins = {}
        for (level, passage), parts in passages.items():
            hits = []
            for piece in parts:
                writers = [t for c, t in known if c == conv and any(lv == 0 and piece in ps for (lv, _), ps in known[c, t].items())]
                if writers and min(writers) < turn:
                    hits.append((len(piece), -min(writers)))
            if hits:
                origins[level, passage] = -max(hits)[1]
        nearest = min((level for level, _ in origins), default=None)
        reply = max((t for (level, _), t in origins.items() if level == nearest), default=None)
        links[conv, turn] = reply
        thread, depth = turn, 0
        while links[conv, thread] is not None:
            thread, depth = links[conv, thread], depth + 1
        out.append((conv, turn, reply, thread, depth, len({p for _, p in passages}), len({p for _, p in origins})))
    return out


def test_links_against_brute_force(spark):
    rows = [(100 * seed + conv, *rest) for seed in range(4) for conv, *rest in conversations(seed)]
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], "conv_id long, turn long, role string, text string, thread string, level int").repartition(3)
    got = chat.linked_messages(frame).collect()
    fields = ("conv_id", "turn", "reply_to", "thread", "depth", "quotes", "linked")
    wanted = brute_links(rows)
    assert sorted(tuple(r[f] for f in fields) for r in got) == wanted
    assert sum(w[6] for w in wanted) > 60 and any(w[4] > 2 for w in wanted)
    order = [(r["conv_id"], r["thread"], r["turn"]) for r in got]
    assert order == sorted(order) and not any(line.startswith(">") for r in got for line in r["text"].split("\n"))


def test_twin_on_generated_conversations(spark):
    """The SQL twin, which the given tables without any quotes do not exercise."""
    rows = [(100 * seed + conv, *rest) for seed in range(10, 13) for conv, *rest in conversations(seed)]
    rows += [(1000, turn, "user", f"On Monday X wrote:\n> {SENTENCES[0]}.\n\n\n\nHe said:\nyes" if turn else SENTENCES[0]) for turn in range(3)]
    rows += [(None, 1, "a", "> x\ny"), (1001, None, "a", None), (1000, 1, "b", "> " + SENTENCES[0]), (1002, 0, None, "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.linked_messages(frame)
    connection = duckdb.connect()
    connection.register("conversations", frame.toArrow())
    wanted = connection.execute(chat.ORACLE_SQL)
    names = [c[0] for c in wanted.description]
    assert names == got.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, wanted.fetchall()))


def test_parts_of_passages(spark):
    rows = [
        (1, 0, "The first point is long. The second one\nis short! And a third?"), (1, 1, "> the second one is short\n\nYes."),
        (1, 2, "> The first point\n> is long. The second\n> one is short! And a third?\nAll three."), (1, 3, "> And a third? Nobody wrote this.\nNo."),
        (1, 4, "> first point\nNot a sentence."), (1, 5, "> Yes.\n>\n> No.\nBoth."),
    ]
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["reply_to"], r["quotes"], r["linked"]) for r in chat.linked_messages(frame).collect()}
    assert got == {0: (None, 0, 0), 1: (0, 1, 1), 2: (0, 1, 1), 3: (0, 1, 1), 4: (None, 1, 0), 5: (3, 2, 2)}


def test_rows_without_place_and_hostile_texts(spark):
    """Null conversations and turns, apart and together, stay; long runs of marks, spaces and line ends take linear time."""
    placeless = [(None, 3, "user", "> hello\nx"), (4, None, None, "> hello\ny"), (None, None, "user", None), (4, None, None, "> hello\ny")]
    hostile = [">" * 300_000 + " x", "> " * 200_000, "a" + " " * 500_000 + "b", "\n" * 400_000 + ">", "\x01\x02" * 1000, "> a\n" * 50_000]
    rows = [*placeless, *((9, i, "user", text) for i, text in enumerate(hostile)), (5, 0, "user", "hello"), (5, 0, "user", "hello")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    start = time.monotonic()
    got = chat.linked_messages(frame).collect()
    assert time.monotonic() - start < 60 and len(got) == len(rows)
    loose = sorted((str(r["conv_id"]), str(r["turn"]), r["text"], r["reply_to"], r["quotes"]) for r in got if r["conv_id"] is None or r["turn"] is None)
    assert loose == [("4", "None", "y", None, 0), ("4", "None", "y", None, 0), ("None", "3", "x", None, 0), ("None", "None", "", None, 0)]
    kept = {r["turn"]: r["text"] for r in got if r["conv_id"] == 9}
    assert kept == {0: "", 1: "", 2: hostile[2], 3: "", 4: "", 5: ""}
