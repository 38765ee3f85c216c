"""One table for artifacts of all kinds: facts of any shape as VARIANT, links as rows, and views as nodes.

What a parser knows of an artifact differs by its kind, so it is one VARIANT column, read by typed paths.  Lists that grow
with the repository, who refers to whom, are rows of their own table and never an array in an artifact's row.  A view is
rows too: every node with its path, the numbers of its place among its siblings from the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators.inherit import handed_down, path_of
from granary.operators.intervals import older_tree
from granary.sources.repository import dealt, put_down

# fixed values: words of a relation's type and what it makes the other end
ROLES = (("COPY", "copybooks"), ("DATASET|READ|WRITE", "datasets"), ("PROGRAM|CALL", "called_programs"), ("FILE", "files"))
# fixed values: lists of facts that are links, by kind: role and path
LISTED = {
    "COBOL": (("copybooks", "$.copybooks_used"), ("datasets", "$.datasets_accessed"), ("called_programs", "$.properties.called_programs")),
    "JCL": (("called_programs", "$.executed_programs"), ("referenced", "$.allocated_datasets")),
    "IDCAMS": (("referenced", "$.defined_clusters"),),
    "DATASET": (("called_programs", "$.properties.programs"), ("copybooks", "$.properties.copybooks")),
}
# fixed values: what an artifact of a kind is called as an entity
ENTITIES = {"COBOL": "Program", "COPYBOOK": "Copybook", "JCL": "Job", "IDCAMS": "VSAMDefinition", "DATASET": "Dataset"}
NO_VIEW = "Structured view is not currently available for this artifact type."
# fixed values: names of the groups of a program without an ownership tree
PROGRAM_GROUPS = (
    ("division_group", "Divisions", "division", "$.properties.divisions"), ("section_group", "Sections", "section", "$.properties.sections"),
    ("paragraph_group", "Paragraphs", "paragraph", "$.properties.paragraphs"), ("copy_group", "COPY References", "copy_reference", "$.copybooks_used"),
    ("file_group", "File References", "file_reference", "$.datasets_accessed"),
)
# fixed values: states of a DD that name no dataset
NO_DATASET = ("UNKNOWN", "DUMMY", "INSTREAM")

_TEXTS, _VARIANTS = "array<string>", "array<variant>"
_NODES = "array<struct<path:array<int>,type:string,name:string,properties:string>>"
_DD = "struct<name:string,dd_name:string,dataset:string,concatenations:array<struct<dataset:string>>>"
_JOB = f"struct<job_level_dds:array<{_DD}>,steps:array<struct<name:string,exec:array<struct<program:string>>,dds:array<{_DD}>>>>"


def of(facts: str | Column, path: str, kind: str) -> Column:
    """A typed reading of facts; null where the path is missing or of another kind."""
    return F.try_variant_get(F.col(facts) if isinstance(facts, str) else facts, path, kind)


def canonical(artifacts: DataFrame) -> DataFrame:
    """artifacts (artifact_id, artifact_type, name, source_file, facts: JSON text) with their kind in capitals, facts as
    VARIANT (null where the text is no JSON, with malformed true), and their entity."""
    kind = F.upper("artifact_type")
    facts = F.try_parse_json("facts")
    entity = F.try_element_at(F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair]), F.col("artifact_type"))
    rows = artifacts.withColumn("malformed", F.col("facts").isNotNull() & facts.isNull()).withColumn("facts", facts).withColumn("artifact_type", kind)
    stated = of("facts", "$.artifact_type", "string")
    other = (F.col("artifact_type") == "OTHER") & stated.isNotNull()
    rows = rows.withColumn("artifact_type", F.when(other, F.upper(stated)).otherwise(F.col("artifact_type")))
    return rows.select("artifact_id", "artifact_type", F.coalesce("name", "artifact_id").alias("name"), "source_file", entity.alias("entity"), "facts", "malformed")


def links(found: DataFrame, edges: DataFrame) -> DataFrame:
    """artifact_id, role, other, place: what an artifact refers to, and what refers to it, each once, in order.

    edges (place, source_id, target_id, rel_type) come first, then the lists of the artifact's own facts; place numbers
    the first mention.  A relation of an artifact with itself counts at its source only.
    """
    known = found.select("artifact_id").distinct()
    role = F.coalesce(*[F.when(F.coalesce("rel_type", F.lit("")).rlike(words), name) for words, name in ROLES])
    at = F.struct(F.lit(0).alias("list"), F.col("place").cast("long").alias("at")).alias("place")
    out = edges.select(F.col("source_id").alias("artifact_id"), F.explode(F.array_compact(F.array(F.lit("references"), role))).alias("role"), F.col("target_id").alias("other"), at)
    back = edges.where("source_id <> target_id").select(F.col("target_id").alias("artifact_id"), F.lit("referenced_by").alias("role"), F.col("source_id").alias("other"), at)
    every = out.unionByName(back).join(known, "artifact_id", "left_semi")
    for kind, lists in LISTED.items():
        for n, (name, path) in enumerate(lists):
            rows = found.where(F.col("artifact_type") == kind).select("artifact_id", F.posexplode(of("facts", path, _TEXTS)).alias("_at", "other"))
            every = every.unionByName(rows.select("artifact_id", F.lit(name).alias("role"), "other", F.struct(F.lit(n + 1).alias("list"), F.col("_at").cast("long").alias("at")).alias("place")))
    first = every.where("other IS NOT NULL").groupBy("artifact_id", "role", "other").agg(F.min("place").alias("place"))
    return first.select("artifact_id", "role", "other", F.col("place.list").alias("list"), F.col("place.at").alias("place"))


def _node(path: list[Column], kind: Column | str, name: Column, properties: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = F.lit(None).cast("string") if properties is None else properties
    return F.struct(F.array(*path).cast("array<int>").alias("path"), kind.alias("type"), name.alias("name"), text.alias("properties"))


def _all(*parts: Column) -> Column:
    return F.flatten(F.array(*[F.coalesce(p, F.array()).cast(_NODES) for p in parts]))


def _listed(items: Column, at: Column, kind: str) -> Column:
    return F.transform(items, lambda x, i: _node([F.lit(0), at, i], kind, x))


def _program(facts: Column) -> Column:
    """A program without an ownership tree: groups of what it lists, those that have something."""
    nodes, before = [], F.lit(0)
    for group, label, kind, path in PROGRAM_GROUPS:
        items = F.coalesce(of(facts, path, _TEXTS), F.array().cast(_TEXTS))
        has, at = F.size(items) > 0, before
        head = F.when(has, F.array(_node([F.lit(0), at], group, F.lit(label))))
        nodes += [head, _listed(items, at, kind)]
        before = before + has.cast("int")
    root = F.when(before > 0, F.array(_node([F.lit(0)], "program", F.col("name"))))
    return _all(root, *nodes)


def _job(facts: Column) -> Column:
    job = of(facts, "$.properties.jcl_hierarchy", _JOB)
    dds, steps = F.coalesce(job["job_level_dds"], F.array()), job["steps"]

    def allocation(path: list[Column], x: Column) -> Column:
        named = F.array_compact(F.concat(F.array(x["dataset"]), F.coalesce(F.transform(x["concatenations"], lambda c: c["dataset"]), F.array().cast(_TEXTS))))
        named = F.filter(named, lambda d: ~F.upper(d).isin(*NO_DATASET) & (d != ""))
        return F.concat(F.array(_node(path, "dd", F.coalesce(x["name"], x["dd_name"], F.lit("UNNAMED")))), F.transform(named, lambda d, k: _node([*path, k], "dataset", d)))

    def step(x: Column, i: Column) -> Column:
        at, runs = F.size(dds) + i, F.coalesce(x["exec"], F.array())
        named = lambda e: F.when(F.upper(e["program"]) != "UNKNOWN", F.concat(e["program"], F.lit(" EXEC"))).otherwise("EXEC")
        inner = F.transform(runs, lambda e, k: _node([F.lit(0), at, k], "exec", named(e)))
        below = F.flatten(F.transform(x["dds"], lambda d, k: allocation([F.lit(0), at, F.size(runs) + k], d)))
        return _all(F.array(_node([F.lit(0), at], "step", F.coalesce(x["name"], F.lit("UNASSIGNED")))), inner, below)

    over = F.flatten(F.transform(dds, lambda d, k: allocation([F.lit(0), k], d)))
    return F.when(job.isNotNull(), _all(F.array(_node([F.lit(0)], "job", F.col("name"))), over, F.flatten(F.transform(steps, step))))


def _definitions(facts: Column) -> Column:
    stated = of(facts, "$.properties.definitions", "array<struct<command:string,name:string,data_component:variant,index_component:variant>>")
    named = F.transform(of(facts, "$.defined_clusters", _TEXTS), lambda c, i: _node([i], "command", F.lit("DEFINE CLUSTER"), F.to_json(F.struct(c.alias("name")))))

    def command(x: Column, i: Column) -> Column:
        data, index = x["data_component"], x["index_component"]
        head = _node([i], "command", F.coalesce(x["command"], F.lit("DEFINE CLUSTER")), F.to_json(F.struct(x["name"].alias("name"))))
        first = F.when(data.isNotNull(), F.array(_node([i, F.lit(0)], "data", F.lit("DATA"), F.to_json(data))))
        second = F.when(index.isNotNull(), F.array(_node([i, data.isNotNull().cast("int")], "index", F.lit("INDEX"), F.to_json(index))))
        return _all(F.array(head), first, second)

    return F.when(F.size(stated) > 0, F.flatten(F.transform(stated, command))).otherwise(named)


def _entries(facts: Column) -> Column:
    entries = of(facts, "$.entries", _VARIANTS)
    kind = lambda e: F.lower(F.coalesce(of(e, "$.entry_type", "string"), F.lit("CATALOG_ENTRY")))
    return F.transform(entries, lambda e, i: _node([i], kind(e), F.coalesce(of(e, "$.name", "string"), F.lit("UNKNOWN")), F.to_json(e)))


def _dataset(facts: Column) -> Column:
    fields = {k: of(facts, f"$.{k}", "string") for k in ("organization", "type", "record_length", "key_length", "key_offset")}
    some = F.coalesce(*[F.nullif(x, F.lit("")) for x in fields.values()]).isNotNull()
    named = F.coalesce(of(facts, "$.dsn", "string"), F.col("name"))
    return F.when(some, F.array(_node([F.lit(0)], "dataset", named, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])))))


def _unfolded(rows: DataFrame) -> DataFrame:
    """Nodes of nested trees (artifact_id, path, kind, node: VARIANT), a level a round."""
    out = None
    while True:
        here = rows.select(
            "artifact_id", "path", F.coalesce(of("node", "$.type", "string"), F.col("kind")).alias("type"), F.coalesce(of("node", "$.name", "string"), F.lit("UNKNOWN")).alias("name"),
            F.coalesce(of("node", "$.properties", "variant"), F.when(F.col("kind") == "field", F.parse_json(_field_facts()))).alias("properties"))
        out = here if out is None else out.unionByName(here)
        below = rows.select("artifact_id", "path", "kind", F.posexplode(of("node", "$.children", _VARIANTS)).alias("_at", "_child"))
        rows = put_down(below.select("artifact_id", F.concat("path", F.array("_at")).alias("path"), "kind", F.col("_child").alias("node")))
        if rows.isEmpty():
            return out


def _field_facts() -> Column:
    return F.to_json(F.struct(*[of("node", f"$.{k}", t).alias(k) for k, t in (("level", "int"), ("pic", "string"), ("usage", "string"), ("byte_length", "int"), ("absolute_offset", "int"), ("occurs", "int"), ("redefines", "string"))]))


def _older_fields(found: DataFrame) -> DataFrame:
    """Nodes of layouts that list flat fields with levels."""
    flat = found.where((F.col("artifact_type") == "COPYBOOK") & of("facts", "$.properties.copybook_model_version", "string").isNull() & of("facts", "$.records", _VARIANTS).isNull())
    rows = flat.select("artifact_id", F.posexplode(of("facts", "$.fields", _VARIANTS)).alias("seq", "node"))
    rows = rows.select(F.col("artifact_id").alias("path"), "seq", "node", F.coalesce(of("node", "$.level", "int"), F.lit(0)).alias("level"), F.to_json(F.struct("artifact_id", "seq")).alias("node_id"))
    rows = put_down(rows)
    tree = older_tree(rows.drop("node"))
    nth = F.row_number().over(W.partitionBy("path", "parent_id").orderBy("seq")) - 1
    placed = handed_down(tree.withColumn("_nth", nth), _path=path_of(F.col("_nth"))).select("node_id", "_path")
    facts = rows.select(F.col("path").alias("artifact_id"), "node_id", "node").join(dealt(placed), "node_id")
    return facts.select("artifact_id", F.col("_path").alias("path"), F.lit("field").alias("type"), F.coalesce(of("node", "$.name", "string"), F.lit("UNKNOWN")).alias("name"), F.parse_json(_field_facts()).alias("properties"))


def view(found: DataFrame) -> DataFrame:
    """artifact_id, path, type, name, properties (VARIANT) of the nodes of all artifacts of `canonical`."""
    facts, kind = F.col("facts"), F.col("artifact_type")
    tree = of("facts", "$.properties.cobol_hierarchy", _VARIANTS)
    has_tree = (kind == "COBOL") & (F.size(tree) > 0)
    flat = (
        F.when((kind == "COBOL") & ~F.coalesce(has_tree, F.lit(False)), _program(facts)).when(has_tree, F.array(_node([F.lit(0)], "program", F.col("name"))).cast(_NODES))
        .when(kind == "JCL", _job(facts)).when(kind == "IDCAMS", _definitions(facts)).when(kind == "CATALOG", _entries(facts)).when(kind == "DATASET", _dataset(facts))
    )
    plain = found.select("artifact_id", F.explode(flat).alias("n")).select("artifact_id", "n.path", "n.type", "n.name", F.parse_json("n.properties").alias("properties"))
    records = F.coalesce(of("facts", "$.records", _VARIANTS), F.when(of("facts", "$.properties.copybook_model_version", "string").isNotNull(), of("facts", "$.fields", _VARIANTS)))
    pieces = of("facts", "$.properties.copybook_fragment_hierarchy", _VARIANTS)
    none = F.size(F.coalesce(records, F.array())) + F.size(F.coalesce(of("facts", "$.fields", _VARIANTS), F.array())) == 0
    roots = F.when(kind == "COPYBOOK", F.when(none, pieces).otherwise(records)).when(has_tree, tree)
    label = F.when(has_tree, "node").when(none, "copybook_fragment").otherwise("field")
    top = found.select("artifact_id", has_tree.alias("_in"), label.alias("kind"), F.posexplode(roots).alias("_at", "node"))
    start = F.when(F.col("_in"), F.array(F.lit(0), F.col("_at"))).otherwise(F.array("_at"))
    nested = _unfolded(put_down(top.select("artifact_id", start.alias("path"), "kind", "node")))
    return plain.unionByName(nested).unionByName(_older_fields(found))


def availability(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """artifact_id, artifact_type, available, message: whether an artifact has a view."""
    counts = nodes.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    rows = found.select("artifact_id", "artifact_type").join(counts, "artifact_id", "left")
    seen = F.col("n_nodes").isNotNull()
    return rows.select("artifact_id", "artifact_type", seen.alias("available"), F.when(~seen, NO_VIEW).alias("message"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


#: The class of what belongs to every dataset; no dataset has that name.
ALL = "*"


def analyses_of_datasets(datasets: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which analyses (analysis_id, related: names) belong to which datasets (dsn), as classes and not as pairs.

    An analysis that names datasets belongs to each of them that there is; one that names none belongs to all.  Entries
    (class, analysis_id) have a class for each dataset, its name, and one class for all; members (dsn, class) tell which
    classes a dataset has.  So the result is as large as what is named, not datasets times analyses.
    """
    known = datasets.where(F.col("dsn") != ALL).select("dsn").distinct()
    named = analyses.select("analysis_id", F.explode(F.array_distinct("related")).alias("class")).join(known.withColumnRenamed("dsn", "class"), "class", "left_semi")
    for_all = analyses.where(F.coalesce(F.size("related"), F.lit(0)) <= 0).select("analysis_id", F.lit(ALL).alias("class"))
    members = known.select("dsn", F.explode(F.array(F.col("dsn"), F.lit(ALL))).alias("class"))
    return named.select("class", "analysis_id").unionByName(for_all.select("class", "analysis_id")), members


def analysis_counts(entries: DataFrame, members: DataFrame) -> DataFrame:
    """dsn, n_named, n_for_all: sizes of a dataset's classes."""
    sizes = entries.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    both = members.join(sizes, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of_all = F.col("class") == ALL
    return both.groupBy("dsn").agg(F.sum(F.when(~of_all, F.col("n")).otherwise(0)).alias("n_named"), F.sum(F.when(of_all, F.col("n")).otherwise(0)).alias("n_for_all"))


def _or_given(facts: Column, paths: tuple[str, ...], kind: str) -> Column:
    """The first of the paths that has something; an empty text or list is nothing."""
    found = [of(facts, p, kind) for p in paths]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in found], F.array().cast(kind)) if kind.startswith("array") else F.coalesce(*[F.nullif(x, F.lit("")) if kind == "string" else x for x in found])


def schemas(found: DataFrame) -> DataFrame:
    """artifact_id, schema_type, schema_name, parts (VARIANT) of programs, jobs, cluster definitions and datasets.

    What a schema says is read from the sections of the facts in their order of precedence.
    """
    kind, facts = F.col("artifact_type"), F.col("facts")
    general = ("$.general_information", "$.metadata")
    texts = lambda name, *more: _or_given(facts, (*more, *(f"{g}.{name}" for g in general)), _TEXTS).alias(name)
    program = F.struct(
        texts("operations", "$.metadata.operations", "$.general_information.operations", "$.semantic_structure.program.execution_flow"), texts("datasets_accessed", "$.dependencies.datasets"),
        texts("copybooks", "$.dependencies.copybooks"), texts("called_programs", "$.dependencies.calledPrograms"), _or_given(facts, ("$.structure.data_structures",), _VARIANTS).alias("data_structures"))
    job = F.struct(_or_given(facts, ("$.semantic_structure.workflow.steps", "$.structure.job.steps"), _VARIANTS).alias("steps"), of(facts, "$.semantic_structure.workflow.job.job_card", "variant").alias("job_card"))
    number = lambda name: _or_given(facts, (*(f"{g}.{name}" for g in general), f"$.{name}", f"$.semantic_structure.dataset.{name}"), "int").alias(name)
    dataset = F.struct(
        _or_given(facts, ("$.general_information.organization", "$.metadata.organization", "$.organization"), "string").alias("organization"), number("key_length"), number("key_offset"), number("record_length"),
        of(facts, "$.semantic_structure.dataset.primary_key", "string").alias("primary_key"), _or_given(facts, ("$.semantic_structure.dataset.alternate_keys",), _TEXTS).alias("alternate_keys"))
    is_dataset = kind.isin("IDCAMS", "DATASET")
    stated = F.coalesce(
        F.when(kind == "COBOL", of(facts, "$.general_information.program_name", "string")), F.when(kind == "JCL", of(facts, "$.semantic_structure.workflow.job.job_name", "string")),
        F.when(is_dataset, _or_given(facts, ("$.general_information.dataset_name", "$.metadata.dataset_name", "$.dataset_name"), "string")), F.when(is_dataset, F.col("artifact_id")), F.upper("artifact_id"))
    parts = F.when(kind == "COBOL", F.to_json(program)).when(kind == "JCL", F.to_json(job)).when(is_dataset, F.to_json(dataset))
    name = F.when(kind == "COBOL", "PROGRAM_SCHEMA").when(kind == "JCL", "JOB_SCHEMA").when(is_dataset, "DATASET_SCHEMA")
    return found.where(name.isNotNull()).select("artifact_id", name.alias("schema_type"), stated.alias("schema_name"), F.parse_json(parts).alias("parts"))


def readiness(layouts: DataFrame, columns: DataFrame, edges: DataFrame) -> DataFrame:
    """artifact_id, readiness, mapped_dataset, n_columns of layouts (artifact_id), by their columns (artifact_id,
    needs_review) and the datasets that use them, edges (place, source_id, target_id, rel_type).

    Without columns a layout cannot be migrated; without a dataset the evidence is missing; else a column under review
    asks for one.
    """
    used = edges.where("rel_type = 'USES_RECORD_LAYOUT' AND source_id IS NOT NULL").groupBy(F.col("target_id").alias("artifact_id")).agg(F.min_by("source_id", "place").alias("mapped_dataset"))
    made = columns.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n_columns"), F.bool_or(F.coalesce("needs_review", F.lit(False))).alias("_review"))
    rows = layouts.select("artifact_id").join(used, "artifact_id", "left").join(made, "artifact_id", "left")
    ready = F.when(F.col("n_columns").isNull(), "NOT_MIGRATABLE").when(F.col("mapped_dataset").isNull(), "INSUFFICIENT_EVIDENCE").when(F.col("_review"), "REVIEW_REQUIRED").otherwise("READY")
    return rows.select("artifact_id", ready.alias("readiness"), "mapped_dataset", F.coalesce("n_columns", F.lit(0)).alias("n_columns"))
