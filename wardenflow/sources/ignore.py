"""Which paths a tree's ignore files leave out (F19, F20), and owners by path rules (S23): rules as rows, looked up by a path's own folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenflow.operators.positional import last_rule, small


def glob_regex(glob: Column) -> Column:
    """A glob's body as a regular expression: ** over folders, * and ? within one, [..] as it stands; other signs are literal."""
    out = F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1")
    for sign, mark in (("**/", "\x01"), ("/**", "\x02"), ("**", "\x03"), ("*", "\x04"), ("?", "\x05"), ("[!", "\x06")):
        out = F.replace(out, F.lit(sign), F.lit(mark))
    for mark, body in (("\x01", "(?:.*/)?"), ("\x02", "/.*"), ("\x03", ".*"), ("\x04", "[^/]*"), ("\x05", "[^/]"), ("\x06", "[^")):
        out = F.replace(out, F.lit(mark), F.lit(body))
    return out


def _folder(file: Column) -> Column:
    return F.when(F.instr(file, "/") > 0, F.regexp_replace(file, "/[^/]*$", "")).otherwise(F.lit(""))


def ignore_rules(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """folder, ord, pattern, keeps, folders_only of the rules of all ignore files among ``files`` (file, content)."""
    own = files.filter((F.col("file") == name) | F.col("file").endswith(f"/{name}"))
    lines = own.select(_folder(F.col("file")).alias("folder"), F.posexplode(F.split("content", r"\r?\n")).alias("ord", "raw")).withColumn("raw", F.regexp_replace("raw", r"(?<!\\)\s+$", ""))
    lines = lines.filter((F.col("raw") != "") & ~F.col("raw").startswith("#")).withColumn("keeps", F.col("raw").startswith("!"))
    lines = lines.withColumn("rule", F.regexp_replace("raw", r"^!|^\\(?=[#!])", "")).withColumn("folders_only", F.col("rule").endswith("/"))
    bare = F.regexp_replace("rule", "/+$", "")
    anchored = F.instr(bare, "/") > 0
    body = glob_regex(F.regexp_replace(bare, "^/", ""))
    pattern = F.concat(F.lit("^"), F.when(anchored, "").otherwise("(?:.*/)?"), body, F.lit("$"))
    return lines.filter(bare != "").select("folder", "ord", pattern.alias("pattern"), "keeps", "folders_only")


def ignored(paths: DataFrame, rules: DataFrame, path: str = "file") -> DataFrame:  # F19, F20
    """``path`` of the paths that ``rules`` leave out.

    A rule speaks of what lies below its own file's folder. For a path and for each folder above it, the last rule that
    matches decides, rules of deeper folders after those of higher ones; a path under a folder that is left out is left
    out too, whatever takes it back. Folders are decided once, however many files they hold.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("target"), (n < F.size(parts)).alias("is_folder")))
    each = paths.select(path).distinct().withColumn("t", F.explode(above)).select(path, "t.*")
    targets = each.select("target", "is_folder").distinct()
    names = F.split("target", "/")
    # the folders above a target, the top one being ''
    homes = targets.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(names) - 1))).withColumn("folder", F.array_join(F.slice(names, F.lit(1), F.col("depth")), "/"))
    relative = F.when(F.col("folder") == "", F.col("target")).otherwise(F.expr("substring(target, length(folder) + 2)"))
    # what explode adds is not in the sizes that Spark guesses from files, so the many are never left to be broadcast by them
    few = small(rules, 10_000)
    met = homes.join(rules.hint("merge") if few is rules else few, "folder").filter((F.col("is_folder") | ~F.col("folders_only")) & F.rlike(relative, F.col("pattern")))
    out = met.groupBy("target", "is_folder").agg(F.max_by("keeps", F.struct("depth", "ord")).alias("keeps")).filter("not keeps")
    return each.join(out.select("target", "is_folder").hint("merge"), ["target", "is_folder"], "left_semi").select(path).distinct()


def not_ignored(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:  # F19
    """``files`` (file, content) without what their own ignore files leave out."""
    rules = ignore_rules(files) if rules is None else rules
    return files.join(ignored(files.select("file"), rules), "file", "left_anti")


def first_files(files: DataFrame, most: int) -> tuple[DataFrame, bool]:  # S1
    """The first ``most`` files in order of their paths, and whether there were more."""
    return files.orderBy("file").limit(most), files.select("file").limit(most + 1).count() > most


def owner_rules(lines: DataFrame) -> DataFrame:  # S23
    """ord, pattern, prefix, owners of CODEOWNERS lines (ord, text); ``prefix`` is the path that every match begins with, '' for none."""
    words = F.filter(F.split(F.regexp_replace("text", "#.*", ""), r"\s+"), lambda x: x != "")
    rows = lines.select("ord", words.alias("w")).filter(F.size("w") > 1).select("ord", F.get("w", F.lit(0)).alias("glob"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("owners"))
    bare = F.regexp_replace(F.col("glob"), "^/+|/+$", "")
    anchored = F.col("glob").startswith("/") | (F.instr(F.regexp_replace(F.col("glob"), "/+$", ""), "/") > 0)
    fixed = F.regexp_extract(bare, r"^[^*?\[]*", 0)
    prefix = F.when(~anchored, "").when(fixed == bare, fixed).otherwise(F.regexp_extract(fixed, r"^(?:.*/)?", 0))
    pattern = F.concat(F.lit("^"), F.when(anchored, "").otherwise("(?:.*/)?"), glob_regex(bare), F.lit("(?:/.*)?$"))
    return rows.select("ord", pattern.alias("pattern"), prefix.alias("prefix"), "owners")


def owned(rows: DataFrame, rules: DataFrame, path: str = "file") -> DataFrame:  # S23, J12
    """``rows`` with ``owners``: those of the last rule that matches the path."""
    matched = F.rlike(F.col(path), F.col("pattern"))
    return last_rule(rows, rules.withColumnRenamed("ord", "rule_ord"), path, "rule_ord", "owners", matched, "prefix")
