"""Chat formatting by a finite-state machine over roles, from a declarative template.

The machine reads a conversation's turns in order. Each turn gives segments: the opening control
string with the role, the text with control strings escaped, and the closing control string. Only
texts of the roles that the template trains on carry the loss flag. A turn that the machine's table
does not allow after the one before is formatted like any other and flagged.

Escaping: all control strings begin with "<|". In a text each "<", backslashes, "|" gets one more
backslash, so that no bare "<|" is left, and taking one away from each gives the text back.

A conversation is one sequence and is read by one task, in order, as a stream: a task holds a batch
of rows and one turn, not the conversation.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import store


@dataclass(frozen=True)
class Template:
    """Control strings, trained roles, and which role may follow which ("" is the beginning)."""

    open: str = "<|im_start|>"
    between: str = "\n"
    close: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")}
    )

    def __post_init__(self) -> None:
        if not (self.open.startswith("<|") and self.close.startswith("<|") and self.between == "\n"):
            raise ValueError("control strings begin with <| and the role ends at a line end")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def segments(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """(text, loss flag) of the segments of a turn."""
    return [(template.open + escape_role(role) + template.between, False), (escape(text), role in template.trained), (template.close, False)]


class Reader:
    """Turns of formatted text that comes in pieces."""

    def __init__(self, template: Template) -> None:
        self.template, self.held = template, ""

    def feed(self, text: str):
        t = self.template
        self.held += text
        while (end := self.held.find(t.close)) >= 0:
            turn, self.held = self.held[:end], self.held[end + len(t.close) :]
            if not turn.startswith(t.open):
                raise ValueError("a turn does not begin with its control string")
            role, _, body = turn[len(t.open) :].partition(t.between)
            yield unescape_role(role), unescape(body)


def format_conversations(df: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of all conversations: conv_id, turn_no, seq, text, loss, in_order.

    Input: conv_id, turn, role, text. Null texts and roles are empty; equal turns are ordered by role
    and then text; a null conv_id is a conversation of its own. turn_no counts turns from 0, seq
    counts segments. Further columns are left behind; an empty table gives no rows.
    """
    template = template or Template()
    store.bounded_batches(df.sparkSession)

    def run(batches):
        import pandas as pd

        conv, state, turn = object(), "", 0
        for pdf in batches:
            out = []
            for key, role, text in zip(pdf["conv_id"].tolist(), pdf["role"], pdf["text"]):
                role, text = (x if isinstance(x, str) else "" for x in (role, text))
                if key != conv:
                    conv, state, turn = key, "", 0
                ok = role in template.follows.get(state, ())
                for k, (piece, loss) in enumerate(segments(role, text, template)):
                    out.append((key, turn, 3 * turn + k, piece, loss, ok))
                state, turn = role, turn + 1
            made = pd.DataFrame(out, columns=["conv_id", "turn_no", "seq", "text", "loss", "in_order"])
            yield made

    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text")
    # Ids go through Python as strings: numbers beside nulls would lose digits there.
    out = rows.mapInPandas(run, "conv_id string, turn_no long, seq long, text string, loss boolean, in_order boolean")
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Read formatted conversations back and digest what they hold, one row a conversation."""
    template = template or Template()
    store.bounded_batches(formatted.sparkSession)

    def run(batches):
        import pandas as pd

        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        conv, now = object(), None

        def result():
            if now["reader"].held:
                raise ValueError("a conversation ends within a turn")
            return (conv, now["turns"], now["all"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"])

        for pdf in batches:
            out = []
            for key, text, loss in zip(pdf["conv_id"].tolist(), pdf["text"], pdf["loss"]):
                if key != conv:
                    if now:
                        out.append(result())
                    conv = key
                    now = {"reader": Reader(template), "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                now["chars"] += len(text)
                if loss:
                    plain = unescape(text)
                    now["loss_chars"] += len(plain)
                    now["loss"].update(plain.encode())
                for role, body in now["reader"].feed(text):
                    now["turns"] += 1
                    now["all"].update(f"{role}\n{body}\n".encode())
            made = pd.DataFrame(out, columns=columns)
            yield made
        if now:
            yield pd.DataFrame([result()], columns=columns)

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select(F.col("conv_id").cast("string").alias("conv_id"), "text", "loss")
    out = rows.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))
