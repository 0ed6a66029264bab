"""Named stages with declared inputs, and paths that look values up in a catalog."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any


class Pipeline:
    """Stages run in the order of their inputs; each sees the results it names, and those alone."""

    def __init__(self) -> None:
        self.stages: dict[str, tuple[tuple[str, ...], Callable[..., Any], Callable[[], bool] | None]] = {}

    def stage(self, name: str, *inputs: str, when: Callable[[], bool] | None = None):
        def add(f: Callable[..., Any]) -> Callable[..., Any]:
            if name in self.stages:
                raise ValueError(f"two stages named {name}")
            self.stages[name] = (inputs, f, when)
            return f

        return add

    def run(self, given: Mapping[str, Any], wanted: str) -> Any:
        """The result of one stage; only stages it needs run, each once. A switched-off stage gives None."""
        done, busy = dict(given), set()

        def get(name: str) -> Any:
            if name not in done:
                if name in busy:
                    raise ValueError(f"{name} needs itself")
                if name not in self.stages:
                    raise KeyError(name)
                busy.add(name)
                inputs, f, when = self.stages[name]
                done[name] = f(*map(get, inputs)) if when is None or when() else None
            return done[name]

        return get(wanted)


def resolve(catalog: Mapping[str, Any], path: str) -> Any:
    """Value at ``a>b>c``; ``<`` steps back up, ``a,b`` gives a list, a trailing ``?`` allows None.

    A name may be any unique part of a key, whatever the case; an unclear or missing name raises KeyError.
    """
    if "," in path:
        return [resolve(catalog, p) for p in path.split(",")]
    optional = path.endswith("?")
    trail, name = [catalog], ""

    def enter(part: str) -> None:
        here = trail[-1]
        keys = list(here) if isinstance(here, Mapping) else list(here.columns)
        found = [k for k in keys if k == part] or [k for k in keys if k.lower() == part.lower()] or [k for k in keys if part.lower() in k.lower()]
        if len(found) != 1:
            raise KeyError(f"{part}: {found}")
        trail.append(here[found[0]])

    try:
        for c in path.rstrip("?") + ">":
            if c in "><":
                if name.strip():
                    enter(name.strip())
                if c == "<":
                    trail.pop()
                name = ""
            else:
                name += c
    except KeyError:
        if optional:
            return None
        raise
    return trail[-1]
