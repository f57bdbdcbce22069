"""Declarative row rules: masks, funnel and combination statistics, downsampling.

A rule is a dict with ``field`` (or ``fields`` for any_not_null), ``op``, one of
``value``, ``values``, ``value_field``, and optionally ``name`` and ``type``. Null logic
is SQL's: a comparison with null is null, an AND of masks is Kleene's, and a null result
does not pass. ``value_field`` compares both sides as strings, so ``lt`` on numbers is
lexicographic there.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = ("raw", "quality", "region", "label", "mapping", "downsample")
_COMPARE = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}
_LISTS, _NULLS = ("in", "not_in"), ("is_null", "is_not_null", "any_not_null")
OPS = (*_COMPARE, *_LISTS, *_NULLS)


def rule_name(rule: dict) -> str:
    """The rule's name, or its fields and operator."""
    return rule.get("name") or f"{rule.get('field') or '_'.join(rule['fields'])}_{rule['op']}"


def check_rules(config: dict) -> None:
    """Raise ValueError unless ``config`` (filters, downsample) can be applied."""
    for i, rule in enumerate(config.get("filters", [])):
        where = f"rule {i}"
        if rule.get("op") not in OPS:
            raise ValueError(f"{where}: unknown op {rule.get('op')!r}")
        if rule["op"] == "any_not_null":
            if not rule.get("fields"):
                raise ValueError(f"{where}: any_not_null needs fields")
        elif not rule.get("field"):
            raise ValueError(f"{where}: field is missing")
        sides = [k for k in ("value", "values", "value_field") if k in rule]
        if rule["op"] in _NULLS and sides:
            raise ValueError(f"{where}: {rule['op']} takes no value")
        if rule["op"] not in _NULLS and len(sides) != 1:
            raise ValueError(f"{where}: one of value, values, value_field is needed")
        if rule["op"] in _LISTS and not isinstance(rule.get("values", rule.get("value")), list):
            raise ValueError(f"{where}: {rule['op']} needs a list")
        if rule.get("type", "quality") not in TYPES:
            raise ValueError(f"{where}: unknown type {rule['type']!r}")
    down = config.get("downsample")
    if down is not None:
        if down.get("method") not in ("head", "random"):
            raise ValueError("downsample: method must be head or random")
        if not isinstance(down.get("size"), int) or down["size"] <= 0:
            raise ValueError("downsample: size must be a positive integer")


def literal(text: str) -> bool | int | float | str:
    """A boolean, integer, float or string, as the text reads."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_rule(spec: str) -> dict:
    """``name=..:field=..:op=..:value=..:type=..`` as a rule; in and not_in take commas."""
    parts = dict(p.split("=", 1) for p in spec.split(":") if "=" in p)
    unknown = set(parts) - {"name", "field", "fields", "op", "value", "values", "value_field", "type"}
    if unknown or "op" not in parts:
        raise ValueError(f"bad rule: {spec}")
    rule: dict = {k: parts[k] for k in ("name", "field", "op", "type", "value_field") if k in parts}
    if "fields" in parts:
        rule["fields"] = parts["fields"].split(",")
    text = parts.get("value", parts.get("values"))
    if text is not None:
        if rule["op"] in _LISTS:
            rule["values"] = [literal(x) for x in text.split(",")]
        else:
            rule["value"] = literal(text)
    return rule


def parse_downsample(spec: str) -> dict:
    """``method:size[:seed]``."""
    method, size, *seed = spec.split(":")
    out: dict = {"method": method, "size": int(size)}
    if seed:
        out["seed"] = int(seed[0])
    check_rules({"downsample": out})
    return out


def with_cli(config: dict, rules: list[str] = (), downsample: str | None = None) -> dict:
    """``config`` with rules from the command line appended and its downsampling replaced."""
    out = {**config, "filters": [*config.get("filters", []), *map(parse_rule, rules)]}
    if downsample:
        out["downsample"] = parse_downsample(downsample)
    check_rules(out)
    return out


def mask(rule: dict) -> Column:
    """The rule as a nullable boolean column."""
    op = rule["op"]
    if op == "any_not_null":
        return reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in rule["fields"]])
    field = F.col(rule["field"])
    if op in ("is_null", "is_not_null"):
        return field.isNull() if op == "is_null" else field.isNotNull()
    if op in _LISTS:
        values = [v for v in rule.get("values", rule.get("value")) if v is not None]
        inside = field.isin(values) if values else F.when(field.isNotNull(), F.lit(False))
        return inside if op == "in" else ~inside
    if "value_field" in rule:
        return _COMPARE[op](field.cast("string"), F.col(rule["value_field"]).cast("string"))
    return _COMPARE[op](field, F.lit(rule["value"]))


def null_passing(m: Column, field: str) -> Column:
    """A mask that lets null values of ``field`` pass."""
    return m | F.col(field).isNull()


def null_failing(m: Column, field: str) -> Column:
    return m & F.col(field).isNotNull()


PREFIX = "__filter_"


def with_masks(df: DataFrame, rules: list[dict]) -> DataFrame:
    """``df`` with a flag column for each rule, computed in one projection."""
    return df.withColumns({PREFIX + rule_name(r): mask(r) for r in rules})


def passing(df: DataFrame, rules: list[dict]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, map(mask, rules), F.lit(True)))


def _count(m: Column) -> Column:
    return F.coalesce(F.sum(m.cast("long")), F.lit(0))


def funnel(df: DataFrame, rules: list[dict], downsample: dict | None = None) -> DataFrame:
    """(step, name, type, rows, pass_alone): rows left after each rule in turn, and rows
    that pass it by itself, from one aggregation over ``df``. Step 0 is all rows; a
    downsampling step reports the smaller of what is left and its size."""
    masks = [mask(r) for r in rules]
    both = [reduce(lambda a, b: a & b, masks[: i + 1]) for i in range(len(masks))]
    one = df.agg(F.count(F.lit(1)).alias("all"), *[_count(m).alias(f"c{i}") for i, m in enumerate(both)], *[_count(m).alias(f"s{i}") for i, m in enumerate(masks)])
    step = lambda i, name, kind, rows, alone: F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.lit(kind).alias("type"), rows.alias("rows"), alone.alias("pass_alone"))
    steps = [step(0, "raw", "raw", F.col("all"), F.col("all"))]
    steps += [step(i + 1, rule_name(r), r.get("type", "quality"), F.col(f"c{i}"), F.col(f"s{i}")) for i, r in enumerate(rules)]
    if downsample:
        left = F.least(F.col(f"c{len(rules) - 1}") if rules else F.col("all"), F.lit(downsample["size"]).cast("long"))
        steps.append(step(len(rules) + 1, "downsample", "downsample", left, left))
    return one.select(F.explode(F.array(*steps)).alias("s")).select("s.*")


def patterns(df: DataFrame, rules: list[dict], most: int = 20) -> DataFrame:
    """(pattern, rows): how many rows pass (1) and fail (0) the rules in each combination,
    with zero for those that do not occur. Null counts as failing. Of over ``most`` rules,
    whose combinations would be too many to list, only those that occur."""
    key = F.concat(*[F.when(mask(r), "1").otherwise("0") for r in rules])
    found = df.groupBy(key.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    if len(rules) > most:
        return found.withColumnRenamed("n", "rows")
    every = df.sparkSession.range(2 ** len(rules)).select(F.lpad(F.bin("id"), len(rules), "0").alias("pattern"))
    return every.join(found, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("rows"))


def downsample(df: DataFrame, rules: list[dict], spec: dict, order_by: list[str]) -> DataFrame:
    """The passing rows that ``spec`` keeps: the first ``size`` by ``order_by`` (head), or by
    a seeded hash of these columns (random). Order comes from columns, as tables have none."""
    rows = passing(df, rules)
    if spec["method"] == "head":
        return rows.orderBy(*order_by).limit(spec["size"])
    return rows.orderBy(F.xxhash64(F.lit(spec.get("seed", 0)), *order_by), *order_by).limit(spec["size"])


def stats_json(df: DataFrame, config: dict) -> str:
    """The statistics of ``config`` over ``df`` as JSON: filters in order and combinations."""
    rows = funnel(df, config["filters"], config.get("downsample")).orderBy("step").collect()  # one row a rule
    combos = {r["pattern"]: r["rows"] for r in patterns(df, config["filters"]).collect()}  # 2^20 at most
    return json.dumps({"filters": [{"name": r["name"], "type": r["type"], "funnel": r["rows"], "pass": r["pass_alone"]} for r in rows], "combinations": combos})


def merge_stats(parts: list[str]) -> str:
    """Statistics of shards added up; the rules must be the same in the same order."""
    read = [json.loads(p) for p in parts]
    names = [[f["name"] for f in r["filters"]] for r in read]
    if any(n != names[0] for n in names):
        raise ValueError("shards have other rules")
    filters = [{**fs[0], "funnel": sum(f["funnel"] for f in fs), "pass": sum(f["pass"] for f in fs)} for fs in zip(*(r["filters"] for r in read))]
    combos: dict[str, int] = {}
    for r in read:
        for k, v in r["combinations"].items():
            combos[k] = combos.get(k, 0) + v
    return json.dumps({"filters": filters, "combinations": combos})


def funnel_shares(steps: DataFrame, order: str = "step", rows: str = "rows") -> DataFrame:
    """A funnel with its share of the first step and of the step before."""
    w = Window.orderBy(order)  # a funnel has as many rows as rules
    return steps.withColumn("share_of_first", F.try_divide(F.col(rows), F.first(rows).over(w))).withColumn("share_of_last", F.try_divide(F.col(rows), F.coalesce(F.lag(rows).over(w), F.col(rows))))


def translate_query(text: str) -> str:
    """A data-frame query string as SQL: ==, &, |, ~ and backticks as they are there."""
    import re

    quoted = re.split(r"('[^']*'|\"[^\"]*\")", text)
    for i in range(0, len(quoted), 2):
        part = quoted[i].replace("==", "=").replace("&", " AND ").replace("|", " OR ").replace("~", " NOT ")
        quoted[i] = re.sub(r"\bnot in\b", "NOT IN", part)
    for i in range(1, len(quoted), 2):
        quoted[i] = "'" + quoted[i][1:-1].replace("'", "''") + "'"
    return re.sub(r"\[([^\]]*)\]", r"(\1)", "".join(quoted))


def usable_queries(df: DataFrame, queries: list[str]) -> list[str]:
    """The query strings that analyse against ``df``; nothing is run."""
    out = []
    for q in queries:
        try:
            df.where(translate_query(q)).schema
            out.append(q)
        except Exception:
            continue
    return out


def rows_before(steps: list[dict], name: str | None = None, type: str | None = None) -> int:
    """Rows left before the first step of a name or type; ``raw`` is the first step itself. ``steps``
    are a funnel's rows in order, one for each rule."""
    key, wanted = ("name", name) if name is not None else ("type", type)
    if wanted == "raw":
        if "raw" not in (steps[0].get("type"), steps[0].get("name")):
            raise ValueError("the first step is not raw")
        return steps[0]["rows"]
    at = next((i for i, s in enumerate(steps) if s.get(key) == wanted), None)
    if not at:
        raise ValueError(f"no step before {key} {wanted}")
    return steps[at - 1]["rows"]


def row_ratio(steps: list[dict], top: dict, bottom: dict) -> float:
    """Rows before one step over rows before another (arguments of ``rows_before``)."""
    below = rows_before(steps, **bottom)
    if below == 0:
        raise ValueError("no rows to divide by")
    return rows_before(steps, **top) / below
