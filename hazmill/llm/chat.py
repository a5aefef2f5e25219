"""Chat formatting proven by a grammar round trip.

Template: ``<<SYS>>text<</SYS>>`` for system, ``[INST]text[/INST]`` for user, ``<s>text</s>`` for
assistant and ``[ROLE=name]text[/ROLE]`` for any other role (name percent-encoded), one after the other.
The parser is deterministic: the marker at its place names the turn, which ends at the first matching
closer; then it removes one backslash after the first character of every control string that has some.

Each turn is rendered as it is, reparsed and compared with its source. A text that doesn't come
back identical is escaped (every control string, whether it has backslashes or not, gets one more)
and tried again, so that texts without conflicts keep their form. That is done turn by turn, in any task. A conversation is its turns' forms joined
in order; `digests` joins them and parses the joined text, without knowing where turns begin, in pieces of about PIECE bytes of whole
forms (the parser goes from turn to turn, so that pieces don't change what it finds), compares the turns with those that
went in and ends the job if they differ. The loss mask is given by places in the forms, and shifted with them.

Defined results: a null text or role is empty; turns are ordered by turn (nulls first), then role and text;
repeated rows are turns of their own; null conversation ids form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import released, slices

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE=", "]", "[/ROLE]")
PIECE = 4 << 20
_TAILS = "<SYS>>|</SYS>>|s>|/s>|INST\\]|/INST\\]|ROLE=|/ROLE\\]"
_CONTROL = re.compile(rf"([<\[])(\\*)({_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAILS})")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's form, and where its text begins and ends in it."""
    opener, closer = MARKS.get(role) or (OTHER[0] + quote(role, safe="") + OTHER[1], OTHER[2])
    return opener + text + closer, len(opener), len(opener) + len(text)


def parse(form: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn at a place: role, text, where its text begins and ends, where the turn ends."""
    for role, (opener, closer) in MARKS.items():
        if form.startswith(opener, at):
            begin = at + len(opener)
            break
    else:
        if not form.startswith(OTHER[0], at):
            raise ValueError(f"no turn at {at}")
        stop = form.index(OTHER[1], at)
        role, begin, closer = unquote(form[at + len(OTHER[0]) : stop]), stop + 1, OTHER[2]
    end = form.index(closer, begin)
    return role, unescape(form[begin:end]), begin, end, end + len(closer)


def format_turn(role: str, text: str) -> tuple[str, str, str, int, int]:
    """Form, recovered role and text, and the text's place in it; escaped only if the plain form doesn't come back identical."""
    for body in (text, escape(text)):
        form, *_ = render(role, body)
        try:
            got = parse(form)
        except ValueError:
            continue
        if got[:2] == (role, text) and got[4] == len(form):
            return form, got[0], got[1], got[2], got[3]
    raise ValueError("a turn doesn't survive its round trip")


def parse_all(form: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(form):
        role, text, _, _, at = parse(form, at)
        out.append((role, text))
    return out


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, form, role, text (both read back from the form), loss_begin, loss_end: where the loss mask lies in the form (equal: nowhere)."""

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            got = [format_turn(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            loss = [(b, e) if r == "assistant" else (0, 0) for _, r, _, b, e in got]
            rows = [batch.column("conv"), batch.column("turn"), *(pa.array([g[k] for g in got], pa.string()) for k in range(3)), *(pa.array([x[k] for x in loss], pa.int64()) for k in range(2))]
            yield pa.RecordBatch.from_arrays(rows, ["conv", "turn", "form", "role", "text", "loss_begin", "loss_end"])

    rows = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(released(formatted), "conv long, turn long, form string, role string, text string, loss_begin long, loss_end long")


def digests(turns: DataFrame) -> DataFrame:
    """One row a conversation from format_turns' rows: the joined forms are parsed, compared with the turns, and the digests are streamed."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done(rows):
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

        def row():
            return {"conv_id": now[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

        def take(forms: list[str], sources: list[tuple[str, str]], masks: list[tuple[int, int]]) -> None:
            whole = "".join(forms)
            found = parse_all(whole)
            if found != sources:
                raise ValueError(f"conversation {now[0]} doesn't survive its round trip")
            state[0] += len(found)
            for role, text in found:
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            at = 0
            for form, (begin, end) in zip(forms, masks):
                loss = unescape(whole[at + begin : at + end])
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                at += len(form)
            state[4] += len(whole)

        for batch in slices(batches, "form", PIECE):
            out = []
            convs = batch.column("conv").to_pylist()
            forms, roles, texts, begins, ends = (batch.column(c).to_pylist() for c in ("form", "role", "text", "loss_begin", "loss_end"))
            cuts = [0, *(k for k in range(1, len(convs)) if convs[k] != convs[k - 1]), len(convs)]
            for a, b in zip(cuts, cuts[1:]):
                if now != (convs[a],):
                    if now:
                        out.append(row())
                    now, state = (convs[a],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                take(forms[a:b], list(zip(roles[a:b], texts[a:b])), list(zip(begins[a:b], ends[a:b])))
            if out:
                yield done(out)
        if now:
            yield done([row()])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "form", "role", "text", "loss_begin", "loss_end")
    return ordered.mapInArrow(released(streamed), schema)
