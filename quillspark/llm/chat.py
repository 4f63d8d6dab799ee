r"""Operator 13, chat formatting: a grammar round trip.

    conversation = "<s>" turn*
    turn = "[SYS]" text "[/SYS]" | "[INST]" text "[/INST]" | "[ANS]" text "</s>" | "[ROLE]" role "[TURN]" text "[/TURN]"

of a system, a user, an assistant and any other role. Each turn is rendered as it is and read again by the parser;
if that gives another role or text, what conflicts is escaped and the turn is read again. Escaping puts a backslash
behind the first character of a control string, and one more where there are some already, so no escaped text holds
a control string and each has one reading. Rows stream in the order of their turns, whose parts follow one another,
so a conversation of any length is formatted, read back and digested without being held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

START, ROLE, TURN, END = "<s>", "[ROLE]", "[TURN]", "[/TURN]"
#: What begins and ends a turn of each role that has marks of its own.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")}
#: The role whose texts are under the loss mask.
LEARNED = "assistant"
_ROLES, _ENDS = {a: r for r, (a, _) in MARKS.items()}, {r: b for r, (_, b) in MARKS.items()}
#: Control strings with the given number of backslashes behind their first character.
_BODY = r"<{0}/?s>|\[{0}/?(?:INST|SYS|ANS|ROLE|TURN)\]"
CONTROL, GUARDED, ANY = (re.compile(_BODY.format(x)) for x in ("", r"\\+", r"\\*"))
LONGEST = max(map(len, (START, "[/INST]", "[/ROLE]", END)))
#: Rows and code points of a batch that is sent on.
ROWS, POINTS = 1024, 1 << 20


def escaped(text: str) -> str:
    return ANY.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescaped(text: str) -> str:
    return GUARDED.sub(lambda m: m[0][0] + m[0][2:], text)


def tokens(chunks: Iterable[str]) -> Iterator[tuple[bool, str]]:
    """(whether it is a control string, string) of a text that comes in chunks, cut anywhere."""
    rest = ""
    for chunk in chunks:
        rest += chunk
        at = 0
        for m in CONTROL.finditer(rest):
            if m.start() > at:
                yield False, rest[at : m.start()]
            yield True, m[0]
            at = m.end()
        # a control string has its only bracket in front, and the last one here may begin one that the next chunk ends
        cut = max(rest.rfind("[", at), rest.rfind("<", at))
        cut = cut if cut > len(rest) - LONGEST else len(rest)
        if cut > at:
            yield False, rest[at:cut]
        rest = rest[max(cut, at) :]
    if rest:
        yield False, rest


def turns(chunks: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a conversation, as it ends; what the grammar doesn't have is a ValueError."""
    begun, role, end, held = False, "", "", []
    for control, s in tokens(chunks):
        if not begun:
            if s != START:
                raise ValueError("a conversation begins with its mark")
            begun = True
        elif not end:
            if s in _ROLES and control:
                role, end = _ROLES[s], _ENDS[_ROLES[s]]
            elif s == ROLE and control:
                end = TURN
            else:
                raise ValueError("a turn begins with a mark of its role")
        elif not control:
            held.append(s)
        elif s != end:
            raise ValueError(f"{s} inside a turn")
        elif end == TURN:
            role, end, held = unescaped("".join(held)), END, []
        else:
            yield role, unescaped("".join(held))
            end, held = "", []
    if end or not begun:
        raise ValueError("a conversation ends within a turn")


def rendered(role: str, text: str) -> tuple[str, int, int, int]:
    """(string, start and end of the text in it, how often it was read) of a turn whose reading gives back role and text."""
    own, said = role, text
    for passes in (1, 2):
        before, after = MARKS.get(role) or (f"{ROLE}{own}{TURN}", END)
        part = before + said + after
        try:
            found = list(turns([START, part]))
        except ValueError:
            found = []
        if found == [(role, text)]:
            return part, len(before), len(before) + len(said), passes
        own, said = escaped(role), escaped(text)  # leaves alone what has no control string, guarded or not
    raise ValueError("a turn doesn't come back as it was")


def sent(rows: Iterator[tuple], names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight
        if len(held) >= ROWS or size >= POINTS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def streamed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in names], strict=True)


def formatted(chats: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The formatted conversations as parts that follow one another, one for each row of chats.

    (conversation, part, text, from, loss_from, loss_to, passes): number of the part, its string, code points of the
    conversation before it, where in the conversation the text under the loss mask begins and ends (null but for
    assistants), and how often it was read until it came back. The rows of a conversation are ordered by turn, null
    first, then by role and text, and repeated rows are turns of their own. A null text is an empty one, a null role an
    empty role, and rows without a conversation are one conversation. Other columns don't matter; no rows give none.
    Equal conversations meet in one task and pass it in a stream, sorted there.
    """
    bounded_batches(chats.sparkSession)
    empty = F.lit("")
    rows = chats.select(F.col(conversation).cast("long").alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role), empty).alias("r"), F.coalesce(F.col(text), empty).alias("t"))
    rows = rows.repartition("c").sortWithinPartitions("c", "n", "r", "t")

    def parts(found):
        for c, group in groupby(streamed(found, ["c", "r", "t"]), itemgetter(0)):
            at = 0
            for i, (_, r, t) in enumerate(group):
                part, a, b, passes = rendered(r, t)
                if i == 0:
                    part, a, b = START + part, a + len(START), b + len(START)
                yield (c, i, part, at, *((at + a, at + b) if r == LEARNED else (None, None)), passes), len(part)
                at += len(part)

    names = [conversation, "part", "text", "from", "loss_from", "loss_to", "passes"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return rows.mapInArrow(lambda found: sent(parts(found), names, kinds), f"`{conversation}` bigint, part bigint, text string, `from` bigint, loss_from bigint, loss_to bigint, passes int")


def read_back(parts: DataFrame, conversation: str = "conv_id", ordered: bool = False) -> DataFrame:
    """What the parser and the loss mask find in formatted conversations, one row for each.

    (conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). `ordered` says that the parts come
    as formatted() gives them; else they are dealt and sorted first. A mask that holds anything but the texts of the
    role that is learned is an error.
    """
    rows = parts.select(F.col(conversation).alias("c"), "part", "text", "from", "loss_from", "loss_to")
    rows = rows if ordered else rows.repartition("c").sortWithinPartitions("c", "part")

    def read(found):
        for c, group in groupby(streamed(found, ["c", "text", "from", "loss_from", "loss_to"]), itemgetter(0)):
            masked, size = hashlib.sha256(), [0, 0]
            said = hashlib.sha256()

            def chunks(group=group, masked=masked, size=size):
                for _, text, at, a, b in group:
                    if a is not None:
                        under = unescaped(text[a - at : b - at])
                        masked.update(under.encode())
                        size[0] += len(under)
                    size[1] += len(text)
                    yield text

            whole, n = hashlib.sha256(), 0
            for role, text in turns(chunks()):
                whole.update(f"{role}\n{text}\n".encode())
                n += 1
                if role == LEARNED:
                    said.update(text.encode())
            if said.digest() != masked.digest():
                raise ValueError(f"conversation {c}: the mask isn't on the learned texts")
            yield (c, n, whole.hexdigest(), size[0], masked.hexdigest(), size[1]), 1

    names = [conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return rows.mapInArrow(lambda found: sent(read(found), names, kinds), f"`{conversation}` bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op13(spark, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(formatted(chats.unionByName(more)), ordered=True)
