"""Stages, their order and their staleness. Runs on the driver: a pipeline has a dozen stages."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    manual: bool = False
    gate: bool = False
    run: Callable[[], None] | None = field(default=None, compare=False)


def order(stages: Iterable[Stage], only: Iterable[str] | None = None) -> list[str]:
    """Names so that each stage follows what it needs; with ``only``, these and all they need. Unknown needs are ignored,
    a cycle raises ValueError."""
    known = {s.name: s for s in stages}
    done: dict[str, bool] = {}  # False while open
    out: list[str] = []
    for first in only if only is not None else known:
        stack = [(first, False)]
        while stack:
            name, leaving = stack.pop()
            if name not in known:
                continue
            if leaving:
                done[name] = True
                out.append(name)
                continue
            if name in done:
                if not done[name]:
                    raise ValueError(f"cycle through {name}")
                continue
            done[name] = False
            stack.append((name, True))
            for n in reversed(known[name].needs):
                if done.get(n) is False:
                    raise ValueError(f"cycle through {n}")
                if n not in done:
                    stack.append((n, False))
    return out


def state(stage: Stage, newest: Callable[[str], float | None], oldest: Callable[[str], float | None]) -> str:
    """``missing-input``, ``never-run``, ``stale`` (an input is newer than the oldest output) or ``fresh``."""
    ins = [newest(p) for p in stage.inputs]
    if any(t is None for t in ins):
        return "missing-input"
    outs = [oldest(p) for p in stage.outputs]
    if not outs or any(t is None for t in outs):
        return "never-run"
    return "stale" if ins and max(ins) > min(outs) else "fresh"


def run(stages: Iterable[Stage], newest, oldest, only: Iterable[str] | None = None, force: bool = False, dry: bool = False) -> list[tuple[str, str]]:
    """(stage, what happened) in order; stops at the first failure. Fresh and manual stages are skipped unless forced or named."""
    known = {s.name: s for s in stages}
    named = set(only or ())
    log: list[tuple[str, str]] = []
    for name in order(known.values(), only):
        s = known[name]
        now = state(s, newest, oldest)
        if s.manual and name not in named:
            log.append((name, "manual"))
        elif now == "missing-input":
            log.append((name, now))
        elif now == "fresh" and not force:
            log.append((name, "fresh"))
        elif dry or s.run is None:
            log.append((name, "would run"))
        else:
            try:
                s.run()
                log.append((name, "ran"))
            except Exception as e:
                log.append((name, f"{'gate' if s.gate else 'stage'} failed: {e}"))
                break
    return log


#: The stages of this engine.
STAGES = (
    Stage("events", outputs=("events",)),
    Stage("market", outputs=("market",), manual=True),
    Stage("chips", outputs=("chips",), manual=True),
    Stage("detections", ("chips",), ("chips",), ("detections",)),
    Stage("slugs", ("events",), ("events",), ("slugs",)),
    Stage("panel", ("events", "market", "detections"), ("events", "market", "detections"), ("panel",)),
    Stage("leakage", ("panel",), ("panel",), ("leakage",), gate=True),
    Stage("market_scores", ("panel",), ("panel",), ("market_scores",)),
    Stage("evaluation", ("market_scores",), ("market_scores",), ("evaluation",)),
    Stage("folds", ("panel",), ("panel",), ("folds",), gate=True),
    Stage("risk", ("market_scores", "slugs"), ("market_scores", "slugs"), ("risk",)),
    Stage("backtest", ("risk", "folds"), ("risk",), ("backtest",)),
)
