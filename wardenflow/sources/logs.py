"""Log sources (S5-S11): lines with numbers, a format vote for each file, and parsers, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardenflow.operators.windows import capped

# Line shapes.
ACCESS = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) ([^" ]+)[^"]*" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?'
COMBINED = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) ([^" ]+)[^"]*" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"'
SYSLOG = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([\w./-]+)(\[\d+\])?:\s?(.*)$"
RFC5424 = r"^<\d+>\d?\s"
FROM_IP = r"\bfrom\s+(\d{1,3}(?:\.\d{1,3}){3})\b"
ISO = r"^(\d{4}-\d{2}-\d{2}[T ][0-9:.,Z+-]*)"
BRACKET = r"^\[(\d{4}-\d{2}-\d{2}[^\]]*)\]"
FORMATS = ("nginx-combined", "common", "json-lines", "syslog", "generic")

MAX_LINE = 8192
BUDGETS = {"quick": 200_000, "standard": 2_000_000, "thorough": 10_000_000}
EVENT = "ts string, ip string, method string, path string, status int, ua string, message string"


def expand_inputs(paths: list[str]) -> list[str]:  # S5
    """Files as they are; of a folder its .log, .jsonl and .txt files and extensionless ones without a NUL, by path."""
    from pathlib import Path

    out: set[str] = set()
    for p in map(Path, paths):
        if p.is_dir():
            for f in p.iterdir():
                if f.is_file() and (f.suffix in (".log", ".jsonl", ".txt") or (not f.suffix and b"\0" not in f.open("rb").read(4096))):
                    out.add(str(f))
        else:
            out.add(str(p))
    return sorted(out)


def read_lines(spark: SparkSession, paths: list[str], base: str = "", max_line: int = MAX_LINE) -> DataFrame:  # S6
    """``file, line, text`` of text files, split files included.

    Rows of a file block come in order; a line's number is its place in the block after what the blocks before hold,
    so no file is read by one task and nothing is sorted.
    """
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    text = F.substring(F.regexp_replace("value", r"\r$", ""), 1, max_line)
    name = F.regexp_replace("file", r"^\w+:/*", "/")
    if base:
        from wardenflow.functions.scalar import rel_loc

        name = rel_loc(name, base)
    return raw.join(blocks, ["file", "block"]).select(name.alias("file"), (F.col("start") + F.col("mid") - F.col("first") + 1).cast("int").alias("line"), text.alias("text"))


def from_texts(spark: SparkSession, texts: dict[str, str], max_line: int = MAX_LINE) -> DataFrame:
    """``file, line, text`` of small texts held in memory."""
    df = spark.createDataFrame([*texts.items()], "file string, content string")
    lines = df.select("file", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "text"))
    total = F.count(F.lit(1)).over(Window.partitionBy("file"))
    lines = lines.withColumn("n", total).filter("not (pos = n - 1 and text = '')")
    return lines.select("file", (F.col("pos") + 1).alias("line"), F.substring("text", 1, max_line).alias("text"))


def is_json_object(text: Column) -> Column:
    return F.ltrim(text).startswith("{") & F.try_parse_json(text).isNotNull()


def line_class(text: Column) -> Column:  # S7
    return (
        F.when(text.rlike(COMBINED), "nginx-combined").when(text.rlike(ACCESS), "common").when(text.rlike(SYSLOG) | text.rlike(RFC5424), "syslog")
        .when(is_json_object(text), "json-lines").when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]") | text.rlike(r"^\[\d{4}-\d{2}-\d{2}"), "generic").otherwise("raw")
    )


def detect_formats(lines: DataFrame, sample: int = 50) -> DataFrame:  # S7
    """``file, format``: the class of at least half of a file's first non-blank lines, else 'raw'; ties by FORMATS."""
    first = capped(lines.filter(F.trim("text") != ""), ["file"], ["line"], sample).withColumn("class", line_class(F.col("text")))
    counts = first.groupBy("file").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("class") == f).alias(f) for f in FORMATS])
    best = F.array_max(F.array(*[F.struct(F.col(f"`{f}`").alias("votes"), F.lit(-i).alias("order"), F.lit(f).alias("format")) for i, f in enumerate(FORMATS)]))
    voted = counts.select("file", "total", best.alias("b"))
    voted = voted.select("file", F.when((F.col("b.votes") > 0) & (F.col("b.votes") * 2 >= F.col("total")), F.col("b.format")).otherwise("raw").alias("format"))
    return lines.select("file").distinct().join(voted, "file", "left").select("file", F.coalesce("format", F.lit("raw")).alias("format"))


def _some(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _event(text: Column, **parts: Column) -> Column:
    none = F.lit(None).cast("string")
    fields = {k: parts.get(k, none) for k in ("ts", "ip", "method", "path")} | {"status": parts.get("status", F.lit(None).cast("int")), "ua": parts.get("ua", none), "message": parts.get("message", text)}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def parse_access(text: Column) -> Column:  # S8
    g = lambda n: F.when(text.rlike(ACCESS), F.regexp_extract(text, ACCESS, n))
    return _event(text, ts=g(3), ip=g(1), method=g(4), path=g(5), status=g(6).cast("int"), ua=F.when(text.rlike(COMBINED), F.regexp_extract(text, COMBINED, 9)))


def parse_json(text: Column) -> Column:  # S9
    """Only strings count as text; a status may be a number or a numeric string."""
    v = F.when(F.ltrim(text).startswith("{"), F.try_parse_json(text))

    def word(*names):
        found = []
        for n in names:
            x = F.try_variant_get(v, f"$['{n}']", "variant")
            found.append(F.when(F.schema_of_variant(x) == "STRING", x.cast("string")))
        return F.coalesce(*found)

    status = F.coalesce(*[F.try_variant_get(v, f"$.{n}", "double") for n in ("status", "status_code")]).cast("int")
    return _event(text, ts=word("time", "@timestamp", "timestamp"), ip=word("ip", "remote_addr", "client_ip"), path=word("path", "url", "request"), status=status, ua=word("user_agent", "ua"), message=F.coalesce(word("msg", "message"), text))


def parse_syslog(text: Column) -> Column:  # S10
    classic, rfc = text.rlike(SYSLOG), text.rlike(RFC5424)
    g = lambda n: F.regexp_extract(text, SYSLOG, n)
    rest = F.regexp_replace(text, RFC5424, "")
    body = F.when(classic, g(5)).when(rfc, rest)
    ts = F.when(classic, g(1)).when(rfc, F.regexp_extract(F.ltrim(rest), r"^(\S+)", 1))
    message = F.when(classic, F.concat(g(2), F.lit(" "), g(3), g(4), F.lit(": "), g(5))).when(rfc, rest).otherwise(text)
    return _event(text, ts=ts, ip=_some(F.regexp_extract(body, FROM_IP, 1)), message=message)


def parse_generic(text: Column) -> Column:  # S11
    return _event(text, ts=F.coalesce(_some(F.regexp_extract(text, ISO, 1)), _some(F.regexp_extract(text, BRACKET, 1))))


def parse_line(fmt: Column, text: Column) -> Column:  # S11
    return F.when(fmt.isin("nginx-combined", "common"), parse_access(text)).when(fmt == "json-lines", parse_json(text)).when(fmt == "syslog", parse_syslog(text)).when(fmt == "generic", parse_generic(text)).otherwise(_event(text))


def parse(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """``file, line, text``, ``idx`` if the lines have one, and the parts of each event under its file's format."""
    joined = lines.join(formats, "file")
    kept = [c for c in ("file", "line", "text", "idx") if c in lines.columns]
    return joined.withColumn("e", parse_line(F.col("format"), F.col("text"))).select(*kept, "format", "e.*")
