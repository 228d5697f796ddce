"""Pattern packs: what to look for in names, in text and as regular expressions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.regex import check_pattern
from tracewell.functions.sql import Sql, case, let, text
from tracewell.functions.text import strip
from tracewell.operators.ranking import with_row_number


@dataclass(frozen=True)
class Pack:
    """Plain patterns are tried first, then regular expressions, each in list order."""

    plain: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()

    def __post_init__(self):
        for pattern in self.regex:
            problem = check_pattern(pattern)
            if problem:
                raise ValueError(f"invalid pattern {pattern!r}: {problem}")

    @property
    def patterns(self) -> tuple[str, ...]:
        return self.plain + self.regex


@dataclass(frozen=True)
class Packs:
    """The content pack serves source files, the shell pack scripts; names are whole basenames."""

    content: Pack = Pack()
    shell: Pack = Pack()
    names: tuple[str, ...] = ()

    def by_kind(self) -> dict[str, Pack]:
        return {"content": self.content, "shell": self.shell}


def pattern_of_line(line: Sql) -> Sql:
    """The pattern a list line holds, null if it holds none: text before the first '#', without
    outer blanks, without one pair of quotes (blanks inside the quotes count)."""
    inner = lambda t: case(
        (f"""startswith({t}, '"') AND endswith({t}, '"')""", f"substring({t}, 2, greatest(length({t}) - 2, 0))"), default=t
    )
    return f"nullif({let(strip(f'substring_index({line}, {text(chr(35))}, 1)'), inner)}, '')"


def parse_pattern_lines(lines: DataFrame) -> DataFrame:
    """``lines(pack, kind, line_no, line)`` -> ``patterns(pack, kind, ord, pattern)``; ``ord`` is
    the pattern's place among its list's patterns."""
    found = lines.withColumn("pattern", F.expr(pattern_of_line("line"))).filter("pattern IS NOT NULL")
    ranked = with_row_number(found, "ord", "line_no", partition=["pack", "kind"])
    return ranked.select("pack", "kind", F.col("ord").cast("int").alias("ord"), "pattern")


def read_patterns(spark: SparkSession, path: str) -> list[str]:
    """Patterns of one list file, in file order. A missing file is an empty list. Lists are
    settings of a few kilobytes, so the driver holds them."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return []
    rows = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split("value", "\r\n|\n|\r")).alias("n", "line")
    )
    parsed = rows.select("n", F.expr(pattern_of_line("line")).alias("p")).filter("p IS NOT NULL")
    return [r.p for r in sorted(parsed.collect(), key=lambda r: r.n)]


def read_packs(spark: SparkSession, lists: dict[str, str]) -> Packs:
    """``lists`` maps files / shell / shell_rx / content / content_rx to paths, as settings do."""
    get = lambda name: tuple(read_patterns(spark, lists[name])) if name in lists else ()
    return Packs(
        content=Pack(get("content"), get("content_rx")),
        shell=Pack(get("shell"), get("shell_rx")),
        names=get("files"),
    )


def patterns_table(spark: SparkSession, packs: Packs) -> DataFrame:
    """The packs as ``patterns(pack, kind, ord, pattern)``."""
    rows: list[tuple[str, str, int, str]] = []

    def add(pack: str, kind: str, patterns: Iterable[str]):
        rows.extend((pack, kind, i, p) for i, p in enumerate(patterns, start=1))

    for name, pack in packs.by_kind().items():
        add(name, "plain", pack.plain)
        add(name, "regex", pack.regex)
    add("names", "file", packs.names)
    return spark.createDataFrame(rows, "pack string, kind string, ord int, pattern string")


def default_packs(spark: SparkSession) -> Packs:
    """The packs that come with this package."""
    root = resources.files("tracewell") / "packs"
    return read_packs(
        spark, {n: f"file:{root / (n + '.txt')}" for n in ("files", "shell", "shell_rx", "content", "content_rx")}
    )
