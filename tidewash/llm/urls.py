"""URL filters: host and path rules, and path templates learned per host."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Allows or blocks a host with its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Tree:
    """How templates are learned. A place in a path whose values make up more than ``fan_share`` of
    its rows, being over ``fan`` values, is variable. Branches merge unless their labels or
    next segments differ by more than chance would (chi-squared, over its mean by this many
    standard deviations). ``depth`` cuts paths if given. A template is rejected from ``purity`` blocked on; ``prior`` labels of the common share smooth it.
    """

    depth: int | None = None
    fan: int = 20
    fan_share: float = 0.05
    deviations: float = 2.0
    purity: float = 0.8
    prior: float = 4.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: what
    follows up to ``?``, ``#`` or the end. Both empty for null or without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does. Rules are a fixed, short list."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tested last and wins
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def segments(path: Column, depth: int | None = None) -> Column:
    """Path segments, those of variable shape as wildcards that keep the shape: numbers, hex strings,
    identifiers; an ending after a dot stays. Segments beyond a ``depth`` are one ``**``."""
    def shape(s: Column) -> Column:
        s = F.regexp_replace(s, r"^[0-9]+(?=$|\.)", "{n}")
        s = F.regexp_replace(s, r"^[0-9A-Fa-f]{8}-?(?:[0-9A-Fa-f]{4}-?){3}[0-9A-Fa-f]{12}(?=$|\.)", "{id}")
        s = F.regexp_replace(s, r"^(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?=$|\.)", "{hex}")
        return F.regexp_replace(s, r"[0-9]{2,}", "{n}")

    parts = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), shape)
    if depth is None:
        return parts
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit("**")))).otherwise(parts)


def templates(paths: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """``host, segments, template`` of distinct ``host, segments`` with ``n, allow, block`` counts.

    The tree of a host grows one level at a time. At each, the values of the next segment under a
    template are counted. Are they many for their rows, they all become one wildcard. Otherwise
    the labelled values whose labels and following segments are distributed like those of all
    labelled values together (chi-squared tests) merge into one branch ``{*}``. Values
    without labels keep a branch of their own, so what is known of one never rejects another.
    """
    rows, level = paths.withColumn("template", F.lit("")), 0
    while True:
        # A path alone under its template branches no more: its other segments stay as they are.
        together = rows.groupBy("host", "template").agg(F.count("*").alias("_paths"), F.max(F.size("segments")).alias("_deepest"))
        if together.where((F.col("_paths") > 1) & (F.col("_deepest") > level)).isEmpty():
            break
        rows = rows.withColumn("_value", F.get("segments", F.lit(level))).withColumn("_next", F.coalesce(F.get("segments", F.lit(level + 1)), F.lit("")))
        here = rows.where(F.col("_value").isNotNull())
        # Categories of a branch: label and following segment.
        kinds = here.groupBy("host", "template", "_value", "_next").agg(*[F.sum(c).alias(c) for c in ("n", "allow", "block")])
        values = kinds.groupBy("host", "template", "_value").agg(*[F.sum(c).alias(c) for c in ("n", "allow", "block")])
        fans = values.groupBy("host", "template").agg(F.count("*").alias("_fan"), F.sum("n").alias("_n"))
        # Two tests of each labelled branch against all of them together: its labels, its following segments.
        labels = F.col("allow") + F.col("block")
        seen = F.array(
            F.struct(F.lit("label").alias("test"), F.lit("allow").alias("kind"), F.col("allow").alias("seen")),
            F.struct(F.lit("label").alias("test"), F.lit("block").alias("kind"), F.col("block").alias("seen")),
            F.struct(F.lit("next").alias("test"), F.col("_next").alias("kind"), labels.alias("seen")),
        )
        cells = kinds.where(labels > 0).select("host", "template", "_value", F.explode(seen).alias("x")).select("host", "template", "_value", "x.*")
        cells = cells.groupBy("host", "template", "_value", "test", "kind").agg(F.sum("seen").alias("seen")).where("seen > 0")
        pooled = cells.groupBy("host", "template", "test", "kind").agg(F.sum("seen").alias("_pool"))
        whole = pooled.groupBy("host", "template", "test").agg(F.sum("_pool").alias("_labels"), F.count("*").alias("_kinds"))
        sizes = values.select("host", "template", "_value", labels.alias("_size")).where("_size > 0")
        joined = cells.join(pooled, ["host", "template", "test", "kind"]).join(sizes, ["host", "template", "_value"]).join(whole, ["host", "template", "test"])
        expected = F.col("_size") * F.col("_pool") / F.col("_labels")
        # Kinds that a branch lacks add their expected count, so the sum needs only the kinds it has.
        chi, free = F.sum((F.col("seen") - expected) ** 2 / expected - expected) + F.max("_size"), F.greatest(F.max("_kinds") - 1, F.lit(1))
        passed = chi <= free + tree.deviations * F.sqrt(2 * free)
        tested = joined.groupBy("host", "template", "_value", "test").agg(passed.alias("_passed")).groupBy("host", "template", "_value").agg(F.bool_and("_passed").alias("_alike"))
        variable = (F.col("_fan") > tree.fan) & (F.col("_fan") > tree.fan_share * F.col("_n"))
        named = F.when(variable, "{var}").when(F.col("_alike") & (F.col("_fan") > 1), "{*}").otherwise(F.col("_value"))
        branches = values.join(fans, ["host", "template"]).join(tested, ["host", "template", "_value"], "left")
        branches = branches.select("host", "template", "_value", F.concat("template", F.lit("/"), named).alias("_branch"))
        rows = staged(
            rows.join(branches, ["host", "template", "_value"], "left").withColumn("template", F.coalesce("_branch", "template")).drop("_branch", "_value", "_next")
        )
        level += 1
    rest = F.slice("segments", F.lit(level + 1), F.greatest(F.size("segments") - level, F.lit(0)))
    return rows.withColumn("template", F.concat("template", F.array_join(F.transform(rest, lambda s: F.concat(F.lit("/"), s)), "")))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, tree: Tree = Tree(), id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict, template, purity``.

    A page that a rule fits gets the longest rule's verdict. These verdicts label the path templates
    of each host. Other pages are judged by the purity of their template: the share of blocked
    labels, smoothed with ``prior`` labels of the overall share. From ``purity`` on they are
    blocked; templates without labels are allowed. Null urls and those without ``://`` have
    empty host and path and are allowed. Rows that repeat an identifier each get a row.
    """
    host, path = host_and_path(F.col(url_column))
    rows = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    text, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", text.alias("rule"), verdict.alias("_ruled"), segments(F.col("path"), tree.depth).alias("segments"))
    paths = staged(rows.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count_if(F.col("_ruled") == "allow").alias("allow"), F.count_if(F.col("_ruled") == "block").alias("block")))
    learned = templates(paths, tree)
    by_template = Window.partitionBy("host", "template")
    block, labels = F.sum("block").over(by_template), F.sum(F.col("allow") + F.col("block")).over(by_template)
    overall = paths.agg(F.sum("block"), F.sum(F.col("allow") + F.col("block"))).first()
    share = (overall[0] or 0) / max(1, overall[1] or 0)
    purity = F.when(labels > 0, (block + tree.prior * share) / (labels + tree.prior))
    learned = learned.select("host", "segments", "template", purity.alias("purity"))
    judged = rows.join(learned, ["host", "segments"])
    chosen = F.coalesce("_ruled", F.when(F.col("purity") >= tree.purity, "block").otherwise("allow"))
    return judged.select("id", "host", "path", "rule", chosen.alias("verdict"), "template", "purity")
