"""Replay of an episode's calls against its plan and its faults, one state a key, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a call does: the node it matches, whether it is credited or repeats one, and the fault that it meets.
OUTCOME = "episode string, call_id long, decision_id long, node int, credited boolean, repeat boolean, fault string, fired boolean"
#: (done nodes with their decisions, last decision, fired faults and until when they block)
STATE = "done string, fired string"


class Episode:
    """The state of one episode: nodes are completed in order, each on a later decision than the one before; a fault fires once,
    and a rate limit goes on refusing until its turns are over."""

    def __init__(self, done: dict[int, int] | None = None, fired: dict[int, int] | None = None):
        self.done, self.fired = done or {}, fired or {}

    def call(self, plan: list[str], faults: dict[int, tuple[str, int]], identity: str, decision: int) -> tuple:
        at = len(self.done)
        order = [at, *(i for i in range(len(plan)) if i != at)] if at < len(plan) else list(range(len(plan)))
        node = next((i for i in order if plan[i] == identity), None)
        if node is None:
            return None, False, False, None, False
        if node != at or node in self.done:
            return node, False, node in self.done, None, False
        if at and self.done[at - 1] >= decision:
            return node, False, False, None, False
        if node in faults:
            kind, turns = faults[node]
            if node not in self.fired:
                self.fired[node] = decision + turns
                return node, False, False, kind, True
            if kind == "rate_limit" and decision < self.fired[node]:
                return node, False, False, kind, False
        self.done[node] = decision
        return node, True, False, None, False


def _plan(row) -> tuple[list[str], dict[int, tuple[str, int]]]:
    return list(row["plan"]), {int(f["node"]): (f["kind"], int(f["turns"])) for f in row["faults"]}


def replayed(calls: DataFrame, specs: DataFrame) -> DataFrame:
    """OUTCOME rows of every call: calls (episode, call_id, decision_id, identity) against specs (episode, plan array<string>,
    faults array<struct<node int, kind string, turns int>>). An episode's calls are a bounded ledger and go to one task."""

    def run(key, ledger: pd.DataFrame, spec: pd.DataFrame) -> pd.DataFrame:
        if not len(spec):
            return pd.DataFrame(columns=["episode", "call_id", "decision_id", "node", "credited", "repeat", "fault", "fired"])
        plan, faults = _plan(spec.iloc[0])
        state, out = Episode(), []
        for row in ledger.sort_values("call_id").itertuples():
            out.append((row.episode, row.call_id, row.decision_id, *state.call(plan, faults, row.identity, row.decision_id)))
        return pd.DataFrame(out, columns=["episode", "call_id", "decision_id", "node", "credited", "repeat", "fault", "fired"])

    return calls.groupBy("episode").cogroup(specs.groupBy("episode")).applyInPandas(run, OUTCOME)


def replay_stream(calls: DataFrame) -> DataFrame:
    """The same over a stream of calls that carry their plan and faults: calls of an episode come in order, and what is done
    and fired is kept between batches."""

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        read = lambda text: {int(k): int(v) for k, v in (x.split(":") for x in text.split(",") if x)}
        write = lambda d: ",".join(f"{k}:{v}" for k, v in d.items())
        episode = Episode(*(read(x) for x in state.get)) if state.exists else Episode()
        out = []
        for row in pd.concat(list(frames)).sort_values("call_id").to_dict("records"):
            plan, faults = _plan(row)
            out.append((row["episode"], row["call_id"], row["decision_id"], *episode.call(plan, faults, row["identity"], row["decision_id"])))
        state.update((write(episode.done), write(episode.fired)))
        yield pd.DataFrame(out, columns=["episode", "call_id", "decision_id", "node", "credited", "repeat", "fault", "fired"])

    return calls.groupBy("episode").applyInPandasWithState(run, OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout)


def agreement(outcome: DataFrame, recorded: DataFrame) -> DataFrame:
    """Calls whose recorded credit or fault isn't what the replay gives; null-safe. Empty means that they agree."""
    b = recorded.selectExpr("episode", "call_id", "credited as was_credited", "fault as was_fault")
    return outcome.join(b, ["episode", "call_id"], "full_outer").where("not (credited <=> was_credited) or not (fault <=> was_fault)")
