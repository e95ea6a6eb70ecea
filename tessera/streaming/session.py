"""Session state as one pure reducer: folded over stored conversations, or kept by Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..dialogue.grammar import parse
from ..dialogue.state import State, apply

SCHEMA = "conv_id long, turn long, state string, dry int"
LAST = 10


class Fold:
    """The state of one conversation: constraints, messages heard, messages since one changed them."""

    def __init__(self, text: str | None = None):
        kept = json.loads(text) if text else {}
        self.state, self.heard, self.dry = State.from_dict(kept.get("state", {})), kept.get("heard", 0), kept.get("dry", 0)

    def dumps(self) -> str:
        return json.dumps({"state": self.state.to_dict(False), "heard": self.heard, "dry": self.dry}, sort_keys=True)

    def hear(self, message: str | None) -> tuple[str, int]:
        """(state as JSON, dry) after a message; null says nothing. The state's turn stays at ten from the tenth on."""
        self.heard += 1
        new = apply(self.state, parse(message or "", self.state, min(self.heard, LAST)))
        self.dry = 0 if new.constraints() != self.state.constraints() else self.dry + 1
        self.state = new
        return json.dumps(new.to_dict(False), sort_keys=True), self.dry


def _rows(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text"))


def fold(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, state, dry) after each row of (conv_id, turn, text), rows in order of turn and text; null
    conversations are one. Rows stream through in sorted partitions, so a conversation of any length needs one state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, None
        for pdf in batches:
            out = []
            for conv, text in zip(pdf["conv_id"], pdf["text"]):
                key = None if pd.isna(conv) else int(conv)
                if kept is None or key != now:
                    now, kept = key, Fold()
                out.append(kept.hear(text if isinstance(text, str) else None))
            states, dry = zip(*out) if out else ((), ())
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "state": list(states), "dry": list(dry)})

    ordered = _rows(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text")
    return ordered.mapInPandas(run, SCHEMA)


def stream(turns: DataFrame) -> DataFrame:
    """The same over a stream: state is kept between micro-batches, turns of one batch are ordered."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        folded = Fold(kept.get[0] if kept.exists else None)
        pdf = pd.concat(list(batches)).sort_values(["turn", "text"], kind="stable")
        out = [folded.hear(t if isinstance(t, str) else None) for t in pdf["text"]]
        kept.update((folded.dumps(),))
        yield pd.DataFrame({"conv_id": key[0], "turn": pdf["turn"], "state": [s for s, _ in out], "dry": [d for _, d in out]})

    return _rows(turns).groupBy("conv_id").applyInPandasWithState(run, SCHEMA, "state string", "append", GroupStateTimeout.NoTimeout)
