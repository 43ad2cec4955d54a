"""Text-to-SQL over typed table chunks: guard, rewrite, run, render. The model that writes the SQL is injected."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AGGREGATES = re.compile(r"\b(sum|avg|max|min|count|group by|distinct)\b")


def guarded(sql: str, keys: tuple[str, ...] = ("doc_id",), fields: list[str] | None = None, most: int = 12) -> str:
    """A single select: lower case outside quotes, cut at ';' or a fence, keys added unless it aggregates, '*' limited to the first fields."""
    text = re.sub(r"(?s)^.*?```(?:sql)?\s*", "", sql) if "```" in sql else sql
    parts = []
    for p in re.split(r"('(?:[^']|'')*')", text):  # quoted text stays as it is; the first end outside of it cuts
        if p.startswith("'"):
            parts.append(p)
            continue
        parts.append(re.sub(r"\s+", " ", re.split(r"[;`]", p)[0].lower()).strip())
        if re.search(r"[;`]", p):
            break
    text = " ".join(parts).strip()
    if not text.startswith("select "):
        raise ValueError("only select statements are run")
    if fields and re.match(r"select \*", text):
        text = "select " + ", ".join(fields[:most]) + text[len("select *") :]
    elif not AGGREGATES.search(text):
        head, rest = text[len("select ") :].split(" from ", 1)
        have = {c.strip() for c in head.split(",")}
        text = "select " + ", ".join([*[k for k in keys if k not in have], head]) + " from " + rest
    return text


def token_matches(sql: str, share: float = 0.3) -> str:
    """Conditions on token columns (``*_tks like|= 'words'``) to a match of ``share`` of the words; other LIKEs stay."""

    def change(m: re.Match) -> str:
        words = sorted({w for w in re.split(r"[^\w]+", m.group(3).lower()) if w})
        items = ", ".join(f"'{w}'" for w in words)
        return f"size(array_intersect({m.group(1)}, array({items}))) >= {max(1, int(share * len(words)))}"

    return re.sub(r"(\w+_l?tks)\s*(like|=)\s*'%?([^']*?)%?'", change, sql)


def ask(spark: SparkSession, question: str, write_sql: Callable[[str, str | None], str], view: str, **options) -> DataFrame:
    """Run the SQL that ``write_sql(question, error)`` proposes, with one more try that sees the error."""
    error = None
    for _ in range(2):
        try:
            return spark.sql(token_matches(guarded(write_sql(question, error), **options)))
        except Exception as e:  # analysis errors go back to the model once
            error = str(e)
    raise ValueError(f"no valid SQL for {view}: {error}")


def markdown(df: DataFrame, most: int = 1024) -> str:
    """The result as a Markdown table; ``most`` rows are shown, as on a page."""
    rows = df.limit(most).collect()
    head = "|" + "|".join(df.columns) + "|\n|" + "|".join("---" for _ in df.columns) + "|"
    return "\n".join([head, *["|" + "|".join("" if v is None else str(v) for v in r) + "|" for r in rows]])


def statements(spark: SparkSession, script: str, most: int = 1024) -> list[DataFrame]:
    """The statements of a script, split at ';', each limited to ``most`` rows."""
    return [spark.sql(s).limit(most) for s in (x.strip() for x in script.split(";")) if s]


def as_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
