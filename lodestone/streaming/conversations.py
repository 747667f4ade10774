"""Rolling conversation state: the last messages verbatim and a bounded summary of all older ones, as a batch and as a stream.

Both walk a conversation's messages in order with the same step, so a stream that was stopped and started again from
its checkpoint ends with what the batch gives.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import registry
from ..operators.folds import ordered_fold

_WIDE = re.compile(registry.TOKEN_WIDE)


def tokens_of(text: str) -> int:
    wide = len(_WIDE.findall(text))
    return wide + math.ceil((len(text) - wide) / 4)


def cut_to_tokens(text: str, most: int) -> str:
    """The longest prefix of at most ``most`` tokens, cut at its last line end where that lies past its half."""
    if tokens_of(text) <= most:
        return text
    low, high = 0, len(text)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if tokens_of(text[:middle]) <= most else (low, middle - 1)
    cut = text[:low]
    line = cut.rfind("\n")
    return (cut[:line] if line > len(cut) // 2 else cut).rstrip()


def _clip(text: str, limit: int) -> str:
    text = " ".join(text.split())
    return text if len(text) <= limit else text[:limit].rstrip() + "…"


def rolled(summary: str, recent: list[tuple[str, str]], role: str, text: str | None) -> tuple[str, list[tuple[str, str]]]:
    """Summary and recent messages after one more; empty messages leave no trace."""
    recent = [*recent, (role, text)] if text else list(recent)
    older, recent = recent[: -registry.KEEP_RECENT], recent[-registry.KEEP_RECENT :]
    if not older:
        return cut_to_tokens(summary.strip(), registry.MAX_SUMMARY_TOKENS), recent
    lines = [f"({len(older)} earlier messages compressed)"]
    users = [t for r, t in older if r == "user"]
    lines += [f"- user goal: {_clip(users[0], registry.GOAL_CHARS)}"] if users else []
    lines += [f"- follow-up: {_clip(t, registry.GOAL_CHARS)}" for t in users[1:3]]
    last = [t for r, t in older if r == "assistant"]
    lines += [f"- last action: {_clip(last[-1], registry.ACTION_CHARS)}"] if last else []
    merged = "\n".join(p for p in (summary.strip(), "\n".join(lines)) if p)
    return cut_to_tokens(merged, registry.MAX_SUMMARY_TOKENS), recent


_ROW = "summary string, recent array<struct<role:string,text:string>>, messages_seen long"


def _row(key, summary, recent, seen) -> tuple:
    return (key, summary, [{"role": r, "text": t} for r, t in recent], seen)


def rolling_state(messages: DataFrame) -> DataFrame:
    """conv_id, summary, recent, messages_seen of each conversation of messages (conv_id, turn, role, text)."""
    kind = messages.schema["conv_id"].dataType.simpleString()

    def step(state, row):
        summary, recent, seen = state
        return (*rolled(summary, recent, row.role, row.text), seen + 1)

    return ordered_fold(messages.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"], lambda key: ("", [], 0), step, lambda key, state: [_row(key[0], *state)], f"conv_id {kind}, {_ROW}")


def rolling_stream(messages: DataFrame) -> DataFrame:
    """The same state of a stream of messages, a row for each conversation that a batch adds to (update mode); turns come in order from batch to batch."""
    kind = messages.schema["conv_id"].dataType.simpleString()

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ("", "[]", 0)
        summary, recent, seen = held[0], [tuple(m) for m in json.loads(held[1])], held[2]
        batch = pd.concat(list(frames)).sort_values("turn", kind="stable")  # a conversation's new messages
        for row in batch.itertuples(index=False):
            summary, recent = rolled(summary, recent, row.role, row.text)
            seen += 1
        state.update((summary, json.dumps(recent), seen))
        yield pd.DataFrame([_row(key[0], summary, recent, seen)], columns=["conv_id", "summary", "recent", "messages_seen"])

    held = "summary string, recent string, seen long"
    return messages.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandasWithState(fold, f"conv_id {kind}, {_ROW}", held, "update", GroupStateTimeout.NoTimeout)
