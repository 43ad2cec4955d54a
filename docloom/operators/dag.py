"""Dataflow graphs: named components over frames, compiled into one lazy plan; branches become filters."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Component:
    """``run`` maps the inputs (one frame per upstream) to a frame, or to a dict of branch name to frame."""

    run: Callable[..., DataFrame | dict[str, DataFrame]]
    upstream: list[str] = field(default_factory=list)


@dataclass
class Flow:
    """Components by name. An upstream 'switch:alarm' is the branch 'alarm' of component 'switch'."""

    components: dict[str, Component] = field(default_factory=dict)

    def add(self, name: str, run: Callable, *upstream: str) -> "Flow":
        self.components[name] = Component(run, list(upstream))
        return self

    def order(self) -> list[str]:
        """Components after what they need; a cycle is an error that names it."""
        done: list[str] = []
        state: dict[str, int] = {}

        def visit(n: str, path: tuple[str, ...]) -> None:
            n = n.split(":")[0]
            if state.get(n) == 2:
                return
            if state.get(n) == 1:
                raise ValueError("cycle: " + " > ".join([*path, n]))
            state[n] = 1
            for u in self.components[n].upstream:
                visit(u, (*path, n))
            state[n] = 2
            done.append(n)

        for n in self.components:
            visit(n, ())
        return done

    def compile(self, **inputs: DataFrame) -> dict[str, DataFrame]:
        """All outputs, lazily; inputs stand under their names."""
        out: dict[str, DataFrame] = dict(inputs)
        for n in self.order():
            if n in inputs:
                continue
            c = self.components[n]
            got = c.run(*[out[u] for u in c.upstream])
            if isinstance(got, dict):
                out.update({f"{n}:{k}": v for k, v in got.items()})
            else:
                out[n] = got
        return out


def switch(**cases: Column):
    """Component: rows go to the first case that holds, else to 'default'. Null conditions do not hold."""

    def run(df: DataFrame) -> dict[str, DataFrame]:
        route = None
        for name, cond in cases.items():
            hit = F.coalesce(cond, F.lit(False))
            route = F.when(hit, name) if route is None else route.when(hit, name)
        routed = df.withColumn("_route", route.otherwise("default") if route is not None else F.lit("default"))
        return {name: routed.where(F.col("_route") == name).drop("_route") for name in [*cases, "default"]}

    return run


def iterate(array: str, each: Callable[[Column], Column], out: str):
    """Component: apply ``each`` to every element of an array column, in order."""
    return lambda df: df.withColumn(out, F.transform(array, each))


def categorize(text: str, labels: list[str], default: str = "other"):
    """Component: the label that a text mentions most often, the first of equals, else the default."""

    def run(df: DataFrame) -> DataFrame:
        n = [F.coalesce(F.regexp_count(F.lower(F.col(text)), F.lit(re.escape(x.lower()))), F.lit(0)) for x in labels]
        best = F.greatest(*n) if len(n) > 1 else n[0]
        label = None
        for x, k in zip(labels, n):
            cond = (k == best) & (best > 0)
            label = F.when(cond, x) if label is None else label.when(cond, x)
        return df.withColumn("category", label.otherwise(default))

    return run


def repeated_path(path: list[str], most: int = 6) -> bool:
    """Whether the tail of a path repeats some pattern more than ``most`` times: a loop."""
    for size in range(1, len(path) // 2 + 1):
        tail, n = path[-size:], 1
        while path[-size * (n + 1) : -size * n or None] == tail:
            n += 1
        if n > most:
            return True
    return False


class Registry:
    """User functions by name, registered with a session as SQL functions."""

    def __init__(self) -> None:
        self.functions: dict[str, tuple] = {}

    def add(self, name: str, f, kind: str = "udf") -> None:
        self.functions[name] = (f, kind)

    def register(self, spark: SparkSession) -> list[str]:
        for name, (f, kind) in self.functions.items():
            (spark.udtf if kind == "udtf" else spark.udf).register(name, f)
        return sorted(self.functions)


FORBIDDEN = re.compile(r"\b(import\s+(os|subprocess|sys|socket|shutil)|__import__|eval|exec|open)\b")


def safe_source(code: str) -> bool:
    """A first scan of user code, on its syntax tree: no imports of system modules, no eval, exec or open."""
    import ast

    try:
        tree = ast.parse(code)
    except SyntaxError:
        return False
    for n in ast.walk(tree):
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            names = [a.name for a in n.names] + [getattr(n, "module", "") or ""]
            if any(x.split(".")[0] in {"os", "subprocess", "sys", "socket", "shutil", "ctypes"} for x in names):
                return False
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in {"eval", "exec", "open", "__import__", "compile"}:
            return False
        if isinstance(n, ast.Attribute) and n.attr.startswith("__"):
            return False
    return True
