"""Slot memory of conversations as a stream: the streaming twin of ``questions.annotate``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyscope.functions import vocab
from tallyscope.operators.questions import resolve_slots, scope_parts

OUTPUT = "conv_id bigint, turn bigint, metric_id string, period string, entity string, allowed boolean, remembered int"
SLOTS = "metric_id string, period string, entity string"


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


class SlotMemory(StatefulProcessor):
    """Last metric, period and entity of a conversation, and its last turns.

    Slots are one small row, turns a list of at most ``history`` entries; both
    expire after the idle time.  A refused turn is seen, but leaves the slots as
    they are.  The turns of a conversation in one micro-batch are put in order;
    that is a few short columns of them, never their texts.
    """

    def __init__(self, idle_seconds: int, history: int):
        self.idle, self.history = idle_seconds * 1000, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getValueState("slots", SLOTS, self.idle)
        self.turns = handle.getListState("turns", "turn bigint", self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        metric, period, entity = self.slots.get() or (None, None, None)
        turns = [r[0] for r in self.turns.get()] if self.turns.exists() else []
        new = sorted((int(r.turn), _text(r.own_metric), _text(r.own_period), _text(r.named_entity), bool(r.is_followup), r.scope_parts) for part in rows for r in part.itertuples(index=False))
        out = []
        for turn, own_metric, own_period, named, followup, parts in new:
            allowed = parts in ("allowed", "followup_greeting") or (parts == "followup" and bool(turns))
            shown = (own_metric or metric, own_period or (period if followup else None), named or entity or "primary")
            if allowed:
                metric, period, entity = own_metric or metric, own_period or period, named or entity
            turns = [*turns, turn][-self.history:]
            out.append((key[0], turn, *shown, allowed, len(turns)))
        self.slots.update((metric, period, entity))
        self.turns.put([(t,) for t in turns])
        yield pd.DataFrame(out, columns=["conv_id", "turn", "metric_id", "period", "entity", "allowed", "remembered"])

    def close(self) -> None:
        pass


def remember_slots(questions: DataFrame, idle_seconds: int = vocab.SESSION_IDLE_SECONDS, history: int = vocab.SESSION_HISTORY) -> DataFrame:
    """Stream of questions (conv_id, turn, text) with remembered slots filled in.

    Finding the slots is a map-only step; only the few slot columns reach the
    state operator, which is keyed by conversation.  State with a time to live
    needs the RocksDB state store (``session.SETTINGS`` names it).
    """
    named = F.when((F.col("entity") != "primary") | F.col("entity_hinted"), F.col("entity"))
    slots = resolve_slots(questions).withColumn("scope_parts", scope_parts("text")).select(
        "conv_id", "turn", "own_metric", F.col("own_period.label").alias("own_period"), named.alias("named_entity"), "is_followup", "scope_parts")
    return slots.groupBy("conv_id").transformWithStateInPandas(SlotMemory(idle_seconds, history), OUTPUT, "Append", "ProcessingTime")
