"""Codebook tables: gold schema, gate maps, hierarchy, checks, name suggestions.

``dims(codebook_id, dim, dim_type, instructions, gated_by, derived_from, category_dimension,
context_dims, sort_order)`` and ``labels(codebook_id, dim, label, definition, examples, path,
sort_order)``. Every operator works on a whole library of codebooks at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maps import last_wins
from ..functions.names import align_key, gate_key, text_or_blank, trimmed
from .rank import first_rows

DIM_KEYS = ["codebook_id", "dim"]
# Label names that mean "no label applies" in a gold schema.
NO_LABEL_NAMES = ["-", "no label", "none", "n/a", "not applicable"]
# Codebook names that say nothing.
GENERIC_NAMES = [
    "codebook",
    "annotation codebook",
    "untitled",
    "untitled codebook",
    "extracted annotation codebook",
]
# Fixed value: instructions of a category dimension made from a gate map.
CATEGORY_INSTRUCTIONS = (
    "Gated by %s: choose the single thematic category for the chosen %s. "
    "Only the categories listed under the predicted %s apply."
)
MAX_FLAT_LABELS = 10
MIN_SIMILAR_LENGTH = 6
MIN_SCORE = 0.3
PREFIX_BONUS = 0.5


# ---- gold schema -----------------------------------------------------------------------------


def gold_schema(dims: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dimensions and labels that gold may use, with their alignment keys.

    A dimension with a ``category_dimension`` adds that dimension: its labels are the distinct last
    path parts of paths longer than one, in first-seen order. A real dimension of that name wins.
    """
    order = F.col("sort_order").cast("double")
    source = dims.filter(F.col("category_dimension") != "").select(
        *DIM_KEYS, "category_dimension", "dim_type", order.alias("dim_order")
    )
    last = F.try_element_at("path", F.lit(-1))
    cats = (
        labels.filter((F.size("path") > 1) & (last != ""))
        .join(source, DIM_KEYS)
        .select(
            "codebook_id",
            F.col("category_dimension").alias("dim"),
            last.alias("label"),
            "sort_order",
            "dim_type",
            "dim_order",
            F.lit(1).alias("derived"),
        )
    )
    none = F.lit(None)
    real = labels.select(
        *DIM_KEYS, "label", "sort_order", none.cast("string").alias("dim_type"),
        none.cast("double").alias("dim_order"), F.lit(0).alias("derived"),
    ).unionByName(
        # a dimension without labels still keeps its name
        dims.select(
            *DIM_KEYS, none.cast("string").alias("label"), none.cast("bigint").alias("sort_order"),
            "dim_type", order.alias("dim_order"), F.lit(0).alias("derived"),
        )
    )
    # of all that offer a dimension the real one wins, then the first dimension that names it
    rows = real.unionByName(cats)
    rank = F.struct("derived", F.when(F.col("derived") == 1, F.col("dim_order")).alias("at"))
    rows = rows.withColumn("_rank", rank).withColumn(
        "_best", F.min("_rank").over(Window.partitionBy(*DIM_KEYS))
    )
    rows = rows.filter(F.col("_rank") == F.col("_best"))
    out_labels = (
        rows.filter(F.col("label").isNotNull())
        .groupBy(*DIM_KEYS, "label")
        .agg(F.min("sort_order").alias("sort_order"))
        .withColumn("label_key", align_key(F.col("label")))
    )
    out_dims = (
        rows.filter(F.col("dim_type").isNotNull())
        .groupBy(*DIM_KEYS)
        .agg(
            F.max_by("dim_type", "dim_order").alias("dim_type"),
            F.max(F.col("dim_order") + F.col("derived") * 0.5).alias("dim_order"),
        )
        .withColumn("dim_key", align_key(F.col("dim")))
    )
    return out_dims, out_labels


def _by_label_key(schema_labels: DataFrame) -> DataFrame:
    """Per dimension: key -> label (the last of a key) and the label that says no label applies."""
    keys = F.array(*[align_key(F.lit(n)) for n in NO_LABEL_NAMES])
    says_none = F.array_contains(keys, F.col("label_key"))
    return (
        schema_labels.groupBy(*DIM_KEYS, "label_key")
        .agg(F.min("sort_order").alias("at"), F.max_by("label", "sort_order").alias("label"))
        .groupBy(*DIM_KEYS)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("label_key", "label"))).alias("label_keys"),
            F.min_by("label", F.when(says_none, F.col("at"))).alias("no_label"),
        )
    )


def no_label_options(schema_labels: DataFrame) -> DataFrame:
    """Per dimension the label that says no label applies, if the codebook has one."""
    found = _by_label_key(schema_labels).select(*DIM_KEYS, "no_label")
    return found.filter(F.col("no_label").isNotNull())


def schema_rows(schema_dims: DataFrame, schema_labels: DataFrame) -> DataFrame:
    """One row per codebook with the lookup maps that row-wise alignment uses.

    Sizes are those of a codebook. Where names share a key the later one is kept.
    """
    info = F.struct(
        "dim_order",
        F.col("dim_type").isin("single_label", "binary").alias("single"),
        F.coalesce("label_keys", F.create_map().cast("map<string,string>")).alias("labels"),
        "no_label",
    )
    per_book = (
        schema_dims.join(_by_label_key(schema_labels), DIM_KEYS, "left")
        .groupBy("codebook_id")
        .agg(F.array_sort(F.collect_list(F.struct("dim_order", "dim", "dim_key"))).alias("names"),
             F.map_from_entries(F.collect_list(F.struct("dim", info.alias("info")))).alias("dims"))
    )
    pairs = F.transform(
        "names", lambda n: F.struct(n["dim_key"].alias("key"), n["dim"].alias("value"))
    )
    return per_book.select("codebook_id", "dims", last_wins(pairs).alias("dim_keys"))


# ---- gate maps and hierarchy -----------------------------------------------------------------


def _first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_rows(df, keys, [order], 1)


def fold_gate_map(
    dims: DataFrame, labels: DataFrame, allowed: DataFrame, leaf_category: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folds "these leaves are allowed under this gate value" into codebooks.

    ``allowed(codebook_id, dimension, gated_by, category_dimension, gate_value, leaf, ord)``;
    ``leaf_category(codebook_id, leaf, category)``. Names meet by gate key. Returns the new dims, the
    new labels (a gated leaf has the gate label as its path) and the dropped rows with a reason.
    """
    names = dims.select("codebook_id", F.col("dim"), gate_key(F.col("dim")).alias("k"), "sort_order")
    names = names.groupBy("codebook_id", "k").agg(F.max_by("dim", "sort_order").alias("dim"))

    def named(df: DataFrame, source: str, target: str) -> DataFrame:
        look = names.select("codebook_id", F.col("k").alias("_k"), F.col("dim").alias(target))
        return df.withColumn("_k", gate_key(F.col(source))).join(
            look, ["codebook_id", "_k"], "left"
        ).drop("_k")

    rows = named(named(allowed, "dimension", "gated_dim"), "gated_by", "gate_dim")
    lab = labels.withColumn("k", gate_key(F.col("label")))
    last_of = lab.groupBy(*DIM_KEYS, "k").agg(
        F.max_by(F.struct("label", "definition", "examples"), "sort_order").alias("v")
    )
    gates = last_of.select(
        "codebook_id", F.col("dim").alias("gate_dim"), F.col("k").alias("gate_k"),
        F.col("v.label").alias("gate_label"),
    )
    leaves = last_of.select(
        "codebook_id", F.col("dim").alias("gated_dim"), F.col("k").alias("leaf_k"), F.col("v").alias("leaf_row")
    )
    rows = (
        rows.withColumn("gate_k", gate_key(F.col("gate_value")))
        .withColumn("leaf_k", gate_key(F.col("leaf")))
        .join(gates, ["codebook_id", "gate_dim", "gate_k"], "left")
        .join(leaves, ["codebook_id", "gated_dim", "leaf_k"], "left")
    )
    reason = (
        F.when(F.col("gated_dim").isNull() | F.col("gate_dim").isNull(), "unknown dimension")
        .when(F.col("gate_label").isNull(), "unknown gate value")
        .when(F.col("leaf_row").isNull(), "unknown leaf")
    )
    rows = rows.withColumn("reason", reason)
    dropped = rows.filter(F.col("reason").isNotNull()).select(
        "codebook_id", "dimension", "gated_by", "gate_value", "leaf", "reason"
    )
    good = _first_by(
        rows.filter(F.col("reason").isNull()), ["codebook_id", "gated_dim", "gate_k", "leaf_k"], "ord"
    )
    new_labels = good.select(
        "codebook_id",
        F.col("gated_dim").alias("dim"),
        F.col("leaf_row.label").alias("label"),
        F.col("leaf_row.definition").alias("definition"),
        F.col("leaf_row.examples").alias("examples"),
        F.array("gate_label").alias("path"),
        F.col("ord").cast("bigint").alias("sort_order"),
    )
    gated = good.groupBy("codebook_id", F.col("gated_dim").alias("dim")).agg(
        F.max_by("gate_dim", "ord").alias("new_gate")
    )
    out_labels = labels.join(gated, DIM_KEYS, "left_anti").select(*new_labels.columns).unionByName(new_labels)
    out_dims = (
        dims.join(gated, DIM_KEYS, "left")
        .withColumn("gated_by", F.coalesce("new_gate", "gated_by"))
        .select(*dims.columns)
    )

    cat_of = leaf_category.select(
        "codebook_id", gate_key(F.col("leaf")).alias("leaf_k"), "category"
    ).groupBy("codebook_id", "leaf_k").agg(F.max("category").alias("category"))
    cats = (
        good.filter(trimmed(text_or_blank(F.col("category_dimension"))) != "")
        .withColumn("cat_dim", trimmed(F.col("category_dimension")))
        .join(cat_of, ["codebook_id", "leaf_k"])
        .filter(F.col("category") != "")
        .withColumn("cat_k", gate_key(F.col("category")))
        .withColumn("_k", gate_key(F.col("cat_dim")))
        .join(names.select("codebook_id", F.col("k").alias("_k")), ["codebook_id", "_k"], "left_anti")
    )
    cats = _first_by(cats, ["codebook_id", "cat_dim", "gate_k", "cat_k"], "ord")
    cat_labels = cats.select(
        "codebook_id",
        F.col("cat_dim").alias("dim"),
        F.col("category").alias("label"),
        F.lit("").alias("definition"),
        F.array().cast("array<string>").alias("examples"),
        F.array("gate_label").alias("path"),
        F.col("ord").cast("bigint").alias("sort_order"),
    )
    cat_dims = (
        _first_by(cats, ["codebook_id", "cat_dim"], "ord")
        .join(
            dims.select("codebook_id", F.col("dim").alias("gated_dim"), "dim_type", "sort_order"),
            ["codebook_id", "gated_dim"],
        )
        .select(
            "codebook_id",
            F.col("cat_dim").alias("dim"),
            "dim_type",
            F.format_string(CATEGORY_INSTRUCTIONS, "gate_dim", "gated_dim", "gate_dim").alias("instructions"),
            F.col("gate_dim").alias("gated_by"),
            F.lit("").alias("derived_from"),
            F.lit("").alias("category_dimension"),
            F.array("gated_dim").alias("context_dims"),
            (F.col("sort_order") + 1000).alias("sort_order"),
        )
    )
    return out_dims.unionByName(cat_dims), out_labels.unionByName(cat_labels), dropped


def clean_hierarchy(labels: DataFrame) -> DataFrame:
    """Drops a leaf that equals one of its ancestors and repeats of (name, path) by gate key."""
    name = gate_key(F.col("label"))
    kept = labels.filter(~F.exists("path", lambda p: gate_key(p) == name))
    kept = kept.withColumn("_n", name).withColumn(
        "_p", F.to_json(F.transform("path", lambda p: gate_key(p)))
    )
    return _first_by(kept, [*DIM_KEYS, "_n", "_p"], "sort_order").drop("_n", "_p")


def tree_rows(labels: DataFrame) -> DataFrame:
    """Lines of the label tree in order: each ancestor not yet shown at its depth, then the leaf."""
    w = Window.partitionBy(*DIM_KEYS).orderBy("sort_order")
    rows = labels.withColumn("_prev", F.coalesce(F.lag("path").over(w), F.array().cast("array<string>")))
    heads = F.filter(
        F.transform(
            "path",
            lambda p, i: F.struct(
                i.alias("depth"), p.alias("node"), F.lit(False).alias("is_leaf"),
                (~F.get(F.col("_prev"), i).eqNullSafe(p)).alias("show"),
            ),
        ),
        lambda s: s["show"],
    )
    leaf = F.array(
        F.struct(
            F.size("path").alias("depth"), F.col("label").alias("node"), F.lit(True).alias("is_leaf"),
            F.lit(True).alias("show"),
        )
    )
    return rows.select(
        *DIM_KEYS, "sort_order", F.col("definition"), F.posexplode(F.concat(heads, leaf)).alias("line", "s")
    ).select(
        *DIM_KEYS, "sort_order", "line", F.col("s.depth").alias("depth"), F.col("s.node").alias("node"),
        F.col("s.is_leaf").alias("is_leaf"), F.when(F.col("s.is_leaf"), F.col("definition")).alias("definition"),
    )


def group_sizes(labels: DataFrame, cap: int | None = None) -> DataFrame:
    """Leaves per top-level path group in source order; flat labels are their own group.

    For a drawing, ``cap`` keeps the first groups; flat dimensions with more labels then show none.
    """
    top = F.coalesce(F.get("path", F.lit(0)), F.col("label"))
    deep = Window.partitionBy(*DIM_KEYS)
    groups = labels.groupBy(*DIM_KEYS, top.alias("group")).agg(
        F.count(F.lit(1)).alias("leaves"),
        F.min("sort_order").alias("first_at"),
        F.max(F.size("path") > 0).alias("_deep"),
    )
    if cap is None:
        return groups.drop("_deep")
    groups = (
        groups.withColumn("_deep", F.max("_deep").over(deep))
        .withColumn("_all", F.sum("leaves").over(deep))
        .filter(F.col("_deep") | (F.col("_all") <= cap))
    )
    return first_rows(groups, DIM_KEYS, ["first_at"], cap).drop("_deep", "_all")


def label_examples(labels: DataFrame, k: int = 2) -> DataFrame:
    """First ``k`` examples of each label, blanks left out afterwards."""
    return (
        labels.select(*DIM_KEYS, "label", "sort_order", F.posexplode(F.slice("examples", 1, k)).alias("pos", "e"))
        .select(*DIM_KEYS, "label", "sort_order", "pos", trimmed(F.col("e")).alias("example"))
        .filter(F.col("example") != "")
    )


# ---- checks ----------------------------------------------------------------------------------


def near_duplicates(labels: DataFrame) -> DataFrame:
    """Equal and contained label names within one branch of a dimension.

    Names are counted first, so k copies of a name are one row with ``pairs`` = k(k-1)/2, and a
    contained name is found through its first six characters, never by comparing all pairs.
    """
    branch = F.to_json(F.transform("path", lambda p: F.lower(p)))
    keys = [*DIM_KEYS, "branch"]
    names = (
        labels.select(*DIM_KEYS, branch.alias("branch"), F.lower("label").alias("name"))
        .filter(F.col("name") != "")
        .groupBy(*keys, "name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    equal = names.filter(F.col("n") > 1).select(
        *keys,
        F.lit("warn").alias("severity"),
        F.col("name").alias("short_name"),
        F.col("name").alias("long_name"),
        (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"),
    )
    size = MIN_SIMILAR_LENGTH
    long_names = names.filter(F.length("name") >= size)
    parts = (
        long_names.filter(F.length("name") > size)
        .withColumn("_c", F.split("name", ""))
        .withColumn(
            "anchors",
            F.array_distinct(
                F.slice(
                    F.transform(
                        "_c", lambda _, i: F.array_join(F.slice(F.col("_c"), i + 1, F.lit(size)), "")
                    ),
                    F.lit(1),
                    F.greatest(F.size("_c") - (size - 1), F.lit(0)),
                )
            ),
        )
        .select(*keys, F.col("name").alias("long_name"), F.col("n").alias("m"), F.explode("anchors").alias("anchor"))
    )
    heads = long_names.select(
        *keys, F.col("name").alias("short_name"), "n", F.substring("name", 1, size).alias("anchor")
    )
    similar = (
        heads.join(parts, [*keys, "anchor"])
        .filter((F.col("short_name") != F.col("long_name")) & F.contains("long_name", "short_name"))
        .select(
            *keys,
            F.lit("info").alias("severity"),
            "short_name",
            "long_name",
            (F.col("n") * F.col("m")).alias("pairs"),
        )
    )
    return equal.unionByName(similar)


def _flag(severity: str, *cols: Column) -> list[Column]:
    return [F.col("codebook_id"), F.col("dim"), F.lit(severity).alias("severity"), *cols]


def codebook_critic(dims: DataFrame, labels: DataFrame) -> DataFrame:
    """Flags per dimension: too few labels, too many flat labels, missing definitions, name clashes.

    Derived dimensions are not judged. ``amount`` is the number of labels or pairs concerned.
    """
    judged = dims.filter(F.coalesce("derived_from", F.lit("")) == "").select(*DIM_KEYS)
    own = labels.join(judged, DIM_KEYS, "left_semi")
    sizes = judged.join(
        own.groupBy(*DIM_KEYS).agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.size("path") > 0).alias("deep"),
            F.count_if(trimmed(text_or_blank(F.col("definition"))) == "").alias("undefined"),
        ),
        DIM_KEYS,
        "left",
    ).fillna(0, ["n", "undefined"])

    def rows(cond: Column, severity: str, kind: str, amount: str) -> DataFrame:
        return sizes.filter(cond).select(
            *_flag(severity, F.lit(kind).alias("kind"), F.col(amount).cast("bigint").alias("amount"))
        )

    n = F.col("n")
    flags = rows(n < 2, "error", "too_few_labels", "n")
    flags = flags.unionByName(
        rows(~F.coalesce("deep", F.lit(False)) & (n > MAX_FLAT_LABELS), "warn", "many_flat_labels", "n")
    ).unionByName(rows(F.col("undefined") > 0, "info", "missing_definition", "undefined"))
    clashes = near_duplicates(own).select(
        "codebook_id",
        "dim",
        "severity",
        F.when(F.col("severity") == "warn", "duplicate_name").otherwise("similar_name").alias("kind"),
        F.col("pairs").alias("amount"),
    )
    return flags.unionByName(clashes.groupBy("codebook_id", "dim", "severity", "kind").agg(
        F.sum("amount").alias("amount")
    ))


def validate_codebook(
    dims: DataFrame, labels: DataFrame, books: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Errors: nameless dimensions or labels, dimensions without labels.

    Strict adds: generic codebook name or missing mode (``books(codebook_id, name, mode)``), a
    single label, labels without definition.
    """
    blank = F.lit("")
    out = [
        dims.filter(F.coalesce("dim", blank) == "").select(
            "codebook_id", F.lit("dimension_without_name").alias("kind"), F.col("sort_order").cast("string").alias("subject")
        ),
        dims.join(labels.select(*DIM_KEYS), DIM_KEYS, "left_anti").select(
            "codebook_id", F.lit("no_labels").alias("kind"), F.col("dim").alias("subject")
        ),
        labels.filter(F.coalesce("label", blank) == "").select(
            "codebook_id", F.lit("label_without_name").alias("kind"), F.concat("dim", F.lit("#"), F.col("sort_order").cast("string")).alias("subject")
        ),
    ]
    if strict:
        out += [
            labels.groupBy(*DIM_KEYS).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 1).select(
                "codebook_id", F.lit("one_label").alias("kind"), F.col("dim").alias("subject")
            ),
            labels.filter(trimmed(text_or_blank(F.col("definition"))) == "").select(
                "codebook_id", F.lit("no_definition").alias("kind"), F.concat("dim", F.lit("/"), "label").alias("subject")
            ),
        ]
        if books is not None:
            name = F.lower(trimmed(text_or_blank(F.col("name"))))
            out += [
                books.filter(F.coalesce("mode", blank) == "").select(
                    "codebook_id", F.lit("no_mode").alias("kind"), F.lit("").alias("subject")
                ),
                books.filter((name == "") | name.isin(GENERIC_NAMES)).select(
                    "codebook_id", F.lit("generic_name").alias("kind"), F.coalesce("name", blank).alias("subject")
                ),
            ]
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first


# ---- suggested names -------------------------------------------------------------------------


DEALT = 64


def _suggest_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_or_blank(c)), "[^a-z0-9]+", " "))


def _suggest_tokens(key: str) -> Column:
    return F.transform(
        F.filter(F.split(F.col(key), " "), lambda t: t != ""),
        lambda t: F.when((F.length(t) > 2) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t),
    )


def _prefixes(key: str) -> Column:
    """Beginnings of a key, itself included; null for an empty key."""
    size = F.length(F.col(key))
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda n: F.substring(F.col(key), F.lit(1), n)))


def _suggest_words(df: DataFrame, key: str) -> DataFrame:
    """One row per different word of a key: how often it is there (times), and how many there are (size)."""
    words = df.withColumn("_all", _suggest_tokens(key)).withColumn("_own", F.array_distinct("_all"))
    one = F.transform(
        "_own", lambda t: F.struct(t.alias("word"), F.size(F.filter("_all", lambda x: x == t)).alias("times"))
    )
    return words.select(*df.columns, F.size("_own").alias("size"), F.inline(one))


def _leading_words(words: DataFrame, keys: list[str], key: str, seen: DataFrame, min_score: float) -> DataFrame:
    """The rarest words of a key, without those at the end that cannot make a score by themselves.

    ``seen`` holds how many keys have a word (n) and how often one name has it at most (most). Words at
    the end go while they are one word, or while all of them, counted that often, are under ``min_score``
    of the key's words. Two keys that share two words or more and reach the score thus
    share one of their leading words: the rarest that they have in common.
    """
    ranked = (
        words.join(seen, [*keys, "word"])
        .groupBy(*keys, key, "size")
        .agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"), F.max("most").alias("most"))
    )
    left = lambda i: F.col("size") - i
    led = F.filter("ranked", lambda _, i: (left(i) > 1) & (left(i) * F.col("most") + 1e-9 >= min_score * F.col("size")))
    return ranked.select(*keys, key, F.explode(F.transform(led, lambda e: e["word"])).alias("word"))


def suggest_mapping(
    unknown: DataFrame, names: DataFrame, scope: list[str] = (), min_score: float = MIN_SCORE
) -> DataFrame:
    """Best codebook name for every distinct unknown name.

    ``unknown(scope, value)``, ``names(scope, name, sort_order)``. Score: token overlap, plus one
    half when one name starts with the other; of equal scores the first in ``sort_order``, then the last
    by name. Below ``min_score`` the suggestion is empty. Null values and names count as empty; an empty
    one begins every other.

    Values and names are compared by key, and of names with one key the best stands for all. A name is met
    through a beginning, or through shared words. Where one word is shared, the score hangs only on the
    sizes, so per word the best name of each size is enough. Where more are, both sides look only at their
    rarest words, as far as the score needs them. A word that most names have makes no pairs.
    """
    keys = list(scope) or ["_scope"]
    if not scope:
        unknown, names = unknown.withColumn("_scope", F.lit(0)), names.withColumn("_scope", F.lit(0))
    values = unknown.select(*keys, "value").distinct().withColumn("ukey", _suggest_key(F.col("value")))
    src = values.select(*keys, "ukey").distinct()
    place = F.struct((-F.col("sort_order")).alias("o"), "name")
    dst = names.withColumn("nkey", _suggest_key(F.col("name"))).groupBy(*keys, "nkey").agg(F.max(place).alias("best"))

    def first(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.max(F.struct("best", "nkey")).alias("b")).select(*by, F.col("b.nkey").alias("nkey"))

    n_words, u_words = _suggest_words(dst, "nkey"), _suggest_words(src, "ukey")
    on = [*keys, "word"]
    one_word = u_words.drop("size", "times").join(first(n_words, [*on, "times", "size"]), on)
    both = n_words.select(*on, "times").unionByName(u_words.select(*on, F.lit(1).alias("times")))
    seen = both.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.max("times").alias("most"))
    u_led, n_led = (_leading_words(w, keys, k, seen, min_score) for w, k in ((u_words, "ukey"), (n_words, "nkey")))
    more_words = u_led.join(n_led, on)

    part = [*keys, "part"]
    whole_u, whole_n = src.withColumn("part", F.col("ukey")), dst.withColumn("part", F.col("nkey"))
    name_longer = whole_u.join(dst.withColumn("part", F.explode(_prefixes("nkey"))), part)
    value_longer = src.withColumn("part", F.explode(_prefixes("ukey"))).join(whole_n, part)
    empty_value = src.filter("ukey = ''").join(first(dst, keys), keys)
    dealt = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))  # the empty name meets every value: in many tasks
    empty_name = src.withColumn("_d", (F.crc32(F.encode("ukey", "UTF-8")) % DEALT).cast("int")).join(
        dst.filter("nkey = ''").withColumn("_d", dealt), [*keys, "_d"]
    )

    pairs = one_word.select(*keys, "ukey", "nkey")
    for found in (more_words, name_longer, value_longer, empty_value, empty_name):
        pairs = pairs.unionByName(found.select(*keys, "ukey", "nkey"))
    pairs = pairs.distinct().join(dst, [*keys, "nkey"])
    pairs = pairs.withColumns({"utok": _suggest_tokens("ukey"), "ntok": _suggest_tokens("nkey")})
    union = F.greatest(F.size(F.array_union("utok", "ntok")), F.lit(1))
    shared = F.size(F.filter("ntok", lambda t: F.array_contains(F.col("utok"), t)))
    bonus = F.when(
        F.startswith("nkey", "ukey") | F.startswith("ukey", "nkey"), F.lit(PREFIX_BONUS)
    ).otherwise(F.lit(0.0))
    best = (
        pairs.withColumn("score", shared / union + bonus)
        .groupBy(*keys, "ukey")
        .agg(F.max(F.struct("score", "best")).alias("b"))
        .select(*keys, "ukey", F.col("b.best.name").alias("suggestion"), F.col("b.score").alias("score"))
        .filter(F.col("score") >= min_score)
    )
    out = values.join(best, [*keys, "ukey"], "left").fillna("", ["suggestion"])
    return out.select(*scope, "value", "suggestion", "score")
