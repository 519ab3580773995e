"""The lease and append state machine of one branch, as a small pure function; batch and stream both fold it.

Commands in order: claim, heartbeat, append, release (finish, suspend, retry), wake. The state is a plain tuple, so
it fits a state store.
"""

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from .folding import in_order

COMMANDS = "branch_id long, n long, command string, at_ms long, epoch long, first_seq long, events int, until_ms long"
VERDICTS = "branch_id long, n long, command string, verdict string, epoch long, head long, attempts int"


class State(NamedTuple):
    epoch: int = 0
    owned: bool = False
    expires_ms: int = 0
    visible_ms: int = 0
    attempts: int = 0
    progress: int = -1
    head: int = -1
    finished: bool = False


def apply(s: State, command: str, at_ms: int, epoch: int, first_seq: int, events: int, until_ms: int, lease_ms: int) -> tuple[State, str]:
    if command == "claim":
        if s.finished:
            return s, "no task"
        if s.visible_ms > at_ms:
            return s, "hidden"
        if s.owned and s.expires_ms > at_ms:
            return s, "leased"
        attempts = 1 if s.attempts == 0 or s.head > s.progress else s.attempts + 1
        return s._replace(epoch=s.epoch + 1, owned=True, expires_ms=at_ms + lease_ms, attempts=attempts, progress=s.head), "claimed"
    if command == "wake":
        return (s, "no task") if s.finished else (s._replace(visible_ms=min(s.visible_ms, at_ms)), "woken")
    if s.finished or epoch != s.epoch:  # fencing comes before all else
        return s, "stale epoch"
    if command == "heartbeat":
        return s._replace(expires_ms=at_ms + lease_ms), "extended"
    if command == "append":
        if events and first_seq != s.head + 1:
            return s, "conflict"
        return s._replace(head=s.head + events), "accepted"
    if command == "finish":
        return s._replace(owned=False, finished=True), "finished"
    if command == "suspend":
        return s._replace(owned=False, visible_ms=until_ms, attempts=0), "suspended"
    if command == "retry":
        return s._replace(owned=False, visible_ms=until_ms), "retried"
    return s, "unknown command"


def fold(rows: pd.DataFrame, state: State, lease_ms: int) -> tuple[pd.DataFrame, State]:
    """Verdicts of one branch's commands, in the order of n."""
    rows, out = rows.sort_values("n"), []
    for values in zip(*(rows[c].tolist() for c in ("command", "at_ms", "epoch", "first_seq", "events", "until_ms"))):
        state, verdict = apply(state, *values, lease_ms)
        out.append((verdict, state.epoch, state.head, state.attempts))
    found = dict(zip(("verdict", "epoch", "head", "attempts"), zip(*out))) if out else {c: [] for c in ("verdict", "epoch", "head", "attempts")}
    return pd.DataFrame({"branch_id": rows["branch_id"].to_numpy(), "n": rows["n"].to_numpy(), "command": rows["command"].to_numpy(), **found}), state


def batch_verdicts(commands: DataFrame, lease_ms: int) -> DataFrame:
    """Verdicts of a whole command log. A branch's state is constant in size; its commands stream through a task in order."""
    names = [x.split()[0] for x in COMMANDS.split(", ")]
    dealt = in_order(commands.select(*names), "branch_id", ["n"])

    def run(batches):
        branch, state = None, State()
        for b in batches:
            for branch_id, own in b.groupby("branch_id", sort=True):
                state = state if branch_id == branch else State()
                out, state = fold(own, state, lease_ms)
                branch = branch_id
                yield out

    return dealt.mapInPandas(run, VERDICTS)
