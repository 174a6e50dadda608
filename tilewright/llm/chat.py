"""Chat formatting: a finite-state machine over roles, and a declarative template with per-segment loss flags.

The template names, for each role, the text before and after a turn and whether the turn's text is under the
loss; the machine names which role may follow which. Rows of a conversation run in order of turn through the
machine, one at a time, and give three segments each: before (no loss), the escaped text, after (no loss).
Control strings inside texts and role names, and the escape mark itself, get the escape mark in front, so
the formatted conversation reads back exactly, whatever it holds.

Conversations are streamed: a task holds one turn at a time, however many turns a conversation has. Defined
results: a null text is empty, a null role is the empty role name, a null turn is before all others, and
ties in turn are put in order of role and text; a null conv_id is a conversation; roles that the template
does not name are formatted like the user's, without loss, and break the turn order; conversations that
break it are formatted, with valid false and the first error; rows alike are turns each; an empty table gives no
rows; other columns of the conversations do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """opening and closing may not start with the escape mark; {role} stands for the role's name."""

    opening: str = "### {role}:\n"
    closing: str = "</turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>")
    escape: str = "\\"
    trained: frozenset[str] = frozenset({"assistant"})
    #: state -> roles that may come next; a state is the last role, "" at the start.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: frozenset[str] = frozenset({"assistant"})

    def _marks(self) -> str:
        return "|".join(re.escape(x) for x in (self.escape, *sorted(self.controls, key=len, reverse=True)))

    def escaped(self, text: str) -> str:
        return re.sub(f"({self._marks()})", lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}({self._marks()})", r"\1", text)

    def role_name(self, role: str) -> str:
        """A role as it stands in the opening: percent-encoded, so it holds no control string or line end."""
        return quote(role, safe="", errors="surrogatepass")

    def role_of(self, name: str) -> str:
        return unquote(name, errors="surrogatepass")

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments (text, under the loss) of one turn."""
        return [(self.opening.format(role=self.role_name(role)), False), (self.escaped(text), role in self.trained), (self.closing, False)]

    def step(self, state: str, role: str) -> str | None:
        """The error of moving from state by role, if it is one."""
        return None if role in self.follows.get(state, ()) else f"{role or 'no role'} after {state or 'the start'}"

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted conversation."""
        before, after = map(re.escape, self.opening.split("{role}"))
        one = re.compile(f"{before}([^\\s:#<]*){after}((?:{re.escape(self.escape)}(?:{self._marks()})|(?!{self._marks()})[\\s\\S])*+){re.escape(self.closing)}")
        out, at = [], 0
        while at < len(formatted):
            if not (found := one.match(formatted, at)):
                raise ValueError(f"no turn at {at}")
            out.append((self.role_of(found[1]), self.unescaped(found[2])))
            at = found.end()
        return out


DEFAULT = Template()
SEGMENTS = "conv_id long, turn_no long, segments array<struct<text:string,loss:boolean>>, error string"


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per turn, in order inside each partition: conv_id, turn_no (from 0), segments (text, loss), error or null.

    All turns of a conversation lie in one partition, one after another.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, number = object(), "", 0
        for batch in batches:
            names, numbers, segments, errors = batch.column("conv_id").to_pylist(), [], [], []
            for name, role, text in zip(names, batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if name != last:
                    last, state, number = name, "", 0
                errors.append(template.step(state, role))
                segments.append([{"text": x, "loss": y} for x, y in template.turn(role, text)])
                numbers.append(number)
                state, number = role, number + 1
            kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(numbers, pa.int64()), pa.array(segments, kind), pa.array(errors, pa.string())], ["conv_id", "turn_no", "segments", "error"])

    return _ordered(conversations).mapInArrow(run, SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, error string"


def digests(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per conversation, read back from what format_turns gave: DIGEST."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done() -> tuple:
            error = held["error"] or (None if held["role"] in template.final else f"it ends after {held['role'] or 'no role'}")
            return held["name"], held["n"], held["turns"].hexdigest(), held["loss_chars"], held["loss"].hexdigest(), held["chars"], error is None, error

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

        for batch in batches:
            rows = []
            for name, number, segments, error in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_no", "segments", "error"))):
                if number == 0:
                    if held:
                        rows.append(done())
                    held = {"name": name, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "error": None, "role": ""}
                whole = "".join(x["text"] for x in segments)
                for role, text in template.parse(whole):
                    held["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    held["n"] += 1
                    held["role"] = role
                for x in segments:
                    if x["loss"]:
                        text = template.unescaped(x["text"])
                        held["loss"].update(text.encode("utf-8", "surrogatepass"))
                        held["loss_chars"] += len(text)
                held["chars"] += len(whole)
                held["error"] = held["error"] or error
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of([done()])

    return turns.mapInArrow(run, DIGEST)


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations and conversation -7, whose texts hold control strings of common templates."""
    said = r"\### Assistant: </turn> ok"
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
