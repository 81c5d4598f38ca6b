"""The rules that turn facts into findings, as joins.

A use is a finding if what it refers to is proven: by the one import that it sees, or, for method calls, by the one
binding of its receiver.  Two bindings before a use prove nothing; a binding after it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .bindings import visible
from .symbols import BASE, CONFIG_KEYS, LIBRARY, VALIDATORS

#: The rules, their categories and severities.
RULES = {
    "config": "high",
    "validator": "high",
    "settings": "high",
    "root_model": "medium",
    "base_model_method": "medium",
    "data_loading": "high",
    "field": "medium",
    "generic_model": "medium",
}
#: Keywords of fields that were removed, and those that are known.
REMOVED_KEYWORDS = ("allow_mutation", "const", "final", "max_items", "min_items", "regex", "unique_items")
KNOWN_KEYWORDS = (
    "alias", "alias_priority", "allow_inf_nan", "coerce_numbers_to_str", "decimal_places", "default", "default_factory", "deprecated",
    "description", "discriminator", "examples", "exclude", "exclude_if", "fail_fast", "field_title_generator", "frozen", "ge", "gt", "init",
    "init_var", "json_schema_extra", "kw_only", "le", "lt", "max_digits", "max_length", "min_length", "multiple_of", "pattern", "repr",
    "serialization_alias", "strict", "title", "union_mode", "validate_default", "validation_alias",
)
FILE = ["archive_id", "relative_path"]
PLACE = ["line", "column", "end_line", "end_column"]


def evidence(**facts: Column) -> Column:
    """The facts that aren't null, sorted by key."""
    each = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("key"), c.alias("value"))) for k, c in sorted(facts.items())])
    return F.array_compact(each)


def canonical(kind: Column, module: Column, imported: Column, level: Column, alias: Column, local: Column, reference: Column) -> Column:
    """The full name of a reference that an import makes visible, null if it isn't known."""
    rest = F.substring(reference, F.length(local) + 1, F.length(reference))
    plain = F.when(alias.isNull(), reference).otherwise(F.concat(module, rest))
    return F.when(kind == "import", plain).when((level == "0") & module.isNotNull(), F.concat_ws("", F.concat(module, F.lit("."), imported), rest))


def _finding(rows: DataFrame, category: Column, construct: Column, api: Column, proof: Column) -> DataFrame:
    severity = F.element_at(F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair]), category)
    return rows.select(
        *FILE, F.concat(F.lit(f"{LIBRARY}_v1_"), category).alias("rule_id"), category.alias("category"), severity.alias("severity"),
        F.col("line").alias("start_line"), F.col("column").alias("start_column"), "end_line", "end_column",
        api.alias("old_api"), construct.alias("matched_construct"), proof.alias("evidence"), F.lit("high").alias("confidence"),
    )


def findings(facts: DataFrame) -> DataFrame:
    """The findings in files whose facts these are; one row each, in no order.

    facts is read by several branches; pass a stored table.
    """
    col = F.col
    prop = lambda k: col("props")[k]
    imports = facts.where("kind = 'import'").withColumn("info", col("props"))
    events = imports.select(*FILE, "name", "scope", "line", "column", "info").unionByName(
        facts.where("kind = 'binding'").select(*FILE, "name", "scope", "line", "column", F.lit(None).cast("map<string,string>").alias("info"))
    )
    # a use is known by its file, its place and what it asks for
    use = [*FILE, "use_id"]
    uses = facts.where("kind = 'use'").withColumn("api", col("name")).withColumn("rule", prop("rule"))
    uses = uses.withColumn("use_id", F.xxhash64("rule", "api", *PLACE, "at_line", "at_column", "reference")).dropDuplicates(use)
    uses = uses.withColumn("name", F.element_at(F.split("reference", r"\."), 1))

    seen = visible(uses, events, use, [*FILE, "name"], ["name", "info"], split=False).where("n = 1 and info is not null").select(*use, col("name").alias("local"), "info")
    # five rules read these
    proven = stage(uses.join(seen, use).withColumn("full", canonical(col("info")["kind"], col("info")["module"], col("info")["imported"], col("info")["level"], col("info")["alias"], col("local"), col("reference"))), "proven")
    symbol = F.element_at(F.split("full", r"\."), -1)

    def imported(rows: DataFrame, category: str, construct: str, api: Column, module: str = LIBRARY, **more: Column) -> DataFrame:
        proof = evidence(import_module=F.lit(module), import_symbol=symbol, local_symbol=col("local"), **more)
        return _finding(rows, F.lit(category), F.lit(construct), api, proof)

    validators = proven.where((col("rule") == "validator") & col("full").isin(*[f"{LIBRARY}.{v}" for v in VALIDATORS]))
    settings = proven.where((col("rule") == "settings") & (col("full") == f"{LIBRARY}.BaseSettings"))
    generics = proven.where((col("rule") == "generic_model") & (col("full") == f"{LIBRARY}.generics.GenericModel"))
    fields = proven.where((col("rule") == "field") & (col("full") == f"{LIBRARY}.Field") & ~col("api").isin(*KNOWN_KEYWORDS))
    kind = F.when(col("api").isin(*REMOVED_KEYWORDS), "removed_or_changed").otherwise("arbitrary_schema_extra")
    out = [
        imported(validators, "validator", "decorator", symbol, decorator_symbol=col("reference")),
        imported(settings, "settings", "settings_reference", F.lit("BaseSettings"), reference_symbol=col("reference")),
        imported(generics, "generic_model", "generic_model_base", F.lit("GenericModel"), f"{LIBRARY}.generics", reference_symbol=col("reference")),
        imported(fields, "field", "field_keyword", col("api"), reference_symbol=col("reference"), field_keyword=col("api"), field_keyword_kind=kind),
    ]

    # an import is a finding in itself, whatever happens to the name later
    for module, name, category in ((LIBRARY, "BaseSettings", "settings"), (f"{LIBRARY}.generics", "GenericModel", "generic_model")):
        rows = imports.where((prop("kind") == "from") & (prop("module") == module) & (prop("imported") == name) & (prop("level") == "0"))
        proof = evidence(import_module=F.lit(module), import_symbol=F.lit(name), local_symbol=col("name"))
        out.append(_finding(rows, F.lit(category), F.lit(f"{category}_import"), F.lit(name), proof))

    classes = facts.where("kind = 'class'").where(prop("evidence") != "none")
    models = classes.select(*FILE, prop("qualified_name").alias("qualified_name"), prop("evidence").alias("model_evidence"), col("line").cast("string").alias("owner_line"), col("column").cast("string").alias("owner_column"))
    owner = ["qualified_name", "owner_line", "owner_column"]
    constructs = facts.where("kind = 'construct'").select(*FILE, "name", *PLACE, prop("construct").alias("construct"), *[prop(k).alias(k) for k in owner]).join(models, [*FILE, *owner])
    key = F.when(col("construct") == "config_key", col("name"))
    proof = evidence(model_evidence=col("model_evidence"), model_qualified_name=col("qualified_name"), config_key=key)
    category = F.when(col("construct") == "root_field", "root_model").otherwise("config")
    out.append(_finding(constructs, category, col("construct"), col("name"), proof))

    out.append(_method_findings(facts, uses, proven, classes, use))
    result = out[0]
    for rows in out[1:]:
        result = result.unionByName(rows)
    return result


def _method_findings(facts: DataFrame, uses: DataFrame, proven: DataFrame, classes: DataFrame, use: list[str]) -> DataFrame:
    """Calls of model methods: the receiver is a name whose one binding is proven, or the imported base itself."""
    col = F.col
    prop = lambda k: col("props")[k]
    # a proof is a class, a parameter or an assignment at the place of a binding; where two stand the last kind counts
    proofs = classes.select(*FILE, "scope", "name", "line", "column", F.lit(0).alias("order"), F.struct(
        F.lit("class_reference").alias("receiver_evidence"), col("name").alias("type_reference"), prop("evidence").alias("model_evidence"), prop("qualified_name").alias("model_qualified_name")
    ).alias("proof"))
    clues = facts.where("kind in ('parameter', 'assignment')").where(prop("is_model") == "true")
    proofs = proofs.unionByName(clues.select(*FILE, "scope", "name", "line", "column", F.when(col("kind") == "parameter", 1).otherwise(2).alias("order"), F.struct(
        prop("evidence").alias("receiver_evidence"), col("reference").alias("type_reference"), prop("model_evidence").alias("model_evidence"), prop("resolved_class").alias("model_qualified_name")
    ).alias("proof")))
    at = [*FILE, "scope", "name", "line", "column"]
    proofs = proofs.groupBy(*at).agg(F.max_by("proof", "order").alias("proof"))

    calls = uses.where(col("rule").isin("base_model_method", "data_loading"))
    simple = calls.where(prop("simple") == "true")
    events = facts.where("kind = 'binding'")
    seen = visible(simple, events, use, [*FILE, "name"], ["name"], split=False)
    receivers = seen.where("n = 1").join(proofs, at).select(*use, "proof")
    local = calls.join(receivers, use)
    how = F.when(prop("called") == "true", "inline_constructor_call").otherwise(col("proof.receiver_evidence"))
    shown = evidence(receiver_evidence=how, type_reference=col("proof.type_reference"), model_evidence=col("proof.model_evidence"), model_qualified_name=col("proof.model_qualified_name"), receiver_symbol=col("reference"))
    construct = F.concat(col("rule"), F.lit("_call"))
    out = _finding(local, col("rule"), construct, col("api"), shown)

    base = proven.where(col("rule").isin("base_model_method", "data_loading") & (col("full") == f"{LIBRARY}.{BASE}"))
    base = base.join(seen.select(*use), use, "left_anti")
    how = F.when(prop("called") == "true", "inline_constructor_call").otherwise("base_model_import")
    shown = evidence(import_module=F.lit(LIBRARY), import_symbol=F.lit(BASE), local_symbol=col("local"), reference_symbol=col("reference"), receiver_evidence=how, receiver_symbol=col("reference"), type_reference=col("reference"))
    return out.unionByName(_finding(base, col("rule"), construct, col("api"), shown))


def sorted_findings(rows: DataFrame) -> DataFrame:
    """The findings in their stable order, for output."""
    return rows.orderBy("archive_id", "relative_path", "start_line", "start_column", "rule_id", "matched_construct", "old_api", "evidence", "end_line", "end_column")


def contract_errors(rows: DataFrame) -> DataFrame:
    """The findings that break the contract: unknown rule, wrong severity, unsorted evidence or a repeated finding."""
    severity = F.element_at(F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (f"{LIBRARY}_v1_{k}", v)]), F.col("rule_id"))
    keys = F.col("evidence.key")
    bad = severity.isNull() | (severity != F.col("severity")) | (keys != F.array_sort(F.array_distinct(keys))) | (F.col("confidence") != "high")
    repeated = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.where(bad).unionByName(repeated)


def detection_scores(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(rule_id, precision, recall, f1) on labels (archive_id, relative_path, start_line, rule_id, expected)."""
    key = ["archive_id", "relative_path", "start_line", "rule_id"]
    want = labels.where("expected").select(*key).distinct().withColumn("want", F.lit(1))
    got = found.select(*key).distinct().withColumn("got", F.lit(1))
    both = want.join(got, key, "full_outer")
    per = both.groupBy("rule_id").agg(F.count_if(F.col("want").isNotNull() & F.col("got").isNotNull()).alias("tp"), F.count("want").alias("positives"), F.count("got").alias("found"))
    precision, recall = F.try_divide("tp", "found"), F.try_divide("tp", "positives")
    return per.select("rule_id", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("tp"), F.col("positives") + F.col("found")).alias("f1"))


def reverse_imports(facts: DataFrame) -> DataFrame:
    """(archive_id, module, importer): one hop, relative levels resolved against the importing file's package."""
    col = F.col
    files = facts.where("kind = 'file'").select(*FILE, col("name").alias("own"), (col("props")["is_package"] == "true").alias("package"))
    found = facts.where("kind = 'import'").select(*FILE, col("props")["module"].alias("module"), col("props")["imported"].alias("imported"), col("props")["level"].cast("int").alias("level")).join(files, FILE)
    parts = F.split("own", r"\.")
    up = F.size(parts) - col("level") + col("package").cast("int")
    home = F.array_join(F.slice(parts, F.lit(1), F.greatest(up, F.lit(0))), ".")
    target = F.when(col("level") == 0, col("module")).otherwise(F.concat_ws(".", F.when(home != "", home), "module"))
    # a from-import names a module or something in it
    named = found.select("archive_id", col("own").alias("importer"), F.explode(F.array_distinct(F.array_compact(F.array(target, F.concat_ws(".", target, "imported"))))).alias("module"))
    known = files.select("archive_id", col("own").alias("module"))
    return named.join(known, ["archive_id", "module"]).where("module <> importer").distinct()
