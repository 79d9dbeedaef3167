"""Extension points: user rules as a SQL table function, parameterised views, queries as text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, StringType, StructType

Rule = Callable[[str], float]


def register_rules(spark: SparkSession, rules: dict[str, Rule], name: str = "apply_rules") -> None:
    """A table function ``name(TABLE(rows), text => 'column', rules => 'a,b')`` in the session.

    It gives the columns of ``rows`` but the text, and (rule, value) for each named rule; all
    rules if none is named. A null text is empty. A rule that raises gives a null value and its
    error, so one bad row does not end a query. The table may be given PARTITION BY; rules see
    one row at a time, rows travel as Arrow batches. Names are checked before anything runs.
    """
    known = dict(rules)

    def chosen(text: str | None) -> list[str]:
        return [r.strip() for r in text.split(",")] if text else sorted(known)

    class Rules:
        @staticmethod
        def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, rules: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument must be a TABLE")
            if text.value not in rows.dataType.names:
                raise ValueError(f"no column {text.value}")
            unknown = [r for r in chosen(rules.value if rules else None) if r not in known]
            if unknown:
                raise ValueError(f"unknown rules: {', '.join(unknown)}")
            taken = {"rule", "value", "error"} & set(rows.dataType.names)
            if taken:
                raise ValueError(f"rename the columns {', '.join(sorted(taken))}")
            kept = StructType([f for f in rows.dataType if f.name != text.value])
            return AnalyzeResult(kept.add("rule", StringType()).add("value", DoubleType()).add("error", StringType()))

        def eval(self, rows: Row, text: str, rules: str | None = None) -> Iterator[tuple]:
            kept = tuple(v for k, v in rows.asDict(recursive=False).items() if k != text)
            for r in chosen(rules):
                try:
                    yield (*kept, r, float(known[r](rows[text] or "")), None)
                except Exception as e:  # noqa: BLE001  a user's rule
                    yield (*kept, r, None, f"{type(e).__name__}: {e}")

    spark.udtf.register(name, udtf(Rules, useArrow=True))


def view(spark: SparkSession, name: str, parameters: str, columns: str, body: str) -> None:
    """A parameterised view: ``SELECT * FROM name(value, ...)`` reads ``body`` with its parameters set.

    Parameters are values of the plan, not text, so Catalyst prunes and pushes them down.
    """
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")


def ask(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None, lenient: bool = False, **values: object) -> DataFrame:
    """Rows of a query given as text over named views, with ``:name`` set from ``values``.

    With ``lenient`` a query that cannot be planned gives no rows and no columns.
    """
    try:
        for name, df in (views or {}).items():
            df.createOrReplaceTempView(name)
        return spark.sql(text, args=values)
    except PySparkException:
        if not lenient:
            raise
        return spark.createDataFrame([], StructType([]))
