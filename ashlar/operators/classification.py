"""Lookup tables and first-match rules over labels, types, paths and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What relationship types stand for, by role.
CONTROL = {
    "NEXT": "sequence", "TRUE": "decision-outcome", "FALSE": "decision-outcome", "EVAL": "initiate", "OPTION_CASE": "decision-outcome",
    "OPTION_DEFAULT": "decision-outcome", "MERGES_TO": "merge", "REJOINS": "merge", "XOR_JOIN": "merge", "REPEATS": "loop", "EXHAUSTED": "completion",
    "SHORT_CIRCUITS": "completion", "CALL": "invoke", "REQUEST": "invoke", "DECLARES_FUNCTION": "declare", "DETACHES_ASYNC": "spawn",
    "AWAITS_ASYNC": "await", "SUBSCRIBE": "subscribe", "INVOKES": "invoke", "ENTERS": "enter",
}
DATA = {
    "PARAM": "bind", "ARG": "transfer", "FIELD": "transfer", "EVAL": "demand", "RESULT": "result", "RESPONSE": "result", "REQUEST": "demand",
    "VALUE": "value", "CREATES_VALUE": "create", "RECEIVES_VALUE": "receive", "READS_VALUE": "read", "WRITES_VALUE": "write", "TARGETS_VALUE": "target",
    "ASSIGNS_VALUE": "assign", "PASSES_VALUE": "transfer", "MATERIALIZES_ARGUMENT": "materialize", "MATERIALIZES_RETURN": "materialize",
    "RETURNS_VALUE": "return", "CLEARS_VALUE": "clear", "DELETES_VALUE": "delete", "CAPTURES_VALUE": "capture", "ITERATES_VALUE": "iterate",
    "PULLS_VALUE": "pull", "ITEM_AVAILABLE": "availability", "EXTRACTS_VALUE": "extract", "YIELDS_VALUE": "yield", "EMITS_VALUE": "emit",
    "ACCUMULATES_VALUE": "accumulate", "DECIDES_VALUE": "decide", "ORDERS_VALUE": "order", "COMPLETES_VALUE": "complete", "ON_RECEIVER": "receiver",
    "PRODUCES_VALUE": "produce", "OF": "source", "ITERATOR": "iterator",
}
STRUCTURE = {"ArgJoin": "argument-boundary", "FieldJoin": "field-boundary", "HAS_FLOW_BLOCK": "containment", "NESTED_IN": "containment", "HAS_METHOD": "containment", "PROXY_OF": "projection"}
EFFECT = {
    "CALL": "call", "REQUEST": "request", "READ": "read", "WRITE": "write", "WRITES": "write", "SUBSCRIBE": "subscribe", "DETACHES_ASYNC": "spawn",
    "AWAITS_ASYNC": "await", "ON_FAILURE": "failure", "PERFORMS_EFFECT": "perform", "EMITS_EFFECT": "emit",
}
ROLES = {"Control": CONTROL, "Data": DATA, "Structure": STRUCTURE, "Effect": EFFECT}

#: The use of relationship types in annotation, whether flow is followed over them, and whether it shows.
POLICY_DEFAULT = (None, True, True, False, True)
POLICY_FIELDS = ("annotation_use", "flow_traversal", "flow_visible", "flow_composition", "functional_visible")
POLICY = {
    "SIGNATURE_PARAMETER": ("binding", True, True, False, True), "SIGNATURE_RETURN": ("type", True, True, False, True), "RETURN_TYPE_ARGUMENT": ("type", False, True, False, True),
    "AWAITS_TYPE": ("type", False, True, False, True), "AST_CHILD": (None, False, False, False, False), "COMPOSES_SYNTAX": ("canonical-bridge", False, False, True, False),
    "HAS_FLOW_BLOCK": (None, False, False, False, True), "HAS_OPERATION": (None, False, False, False, True), "HAS_PARAMETER": (None, False, False, False, True),
    "RESOLVES_TO": ("resolution", False, False, False, True), "USES_REFERENCE": ("resolution", False, False, False, True), "RECEIVES_VALUE": ("binding", False, False, False, True),
    "READS_VALUE": ("binding", False, False, False, True), "CAPTURES_VALUE": ("binding", False, False, False, True), "EVAL": ("composition", True, True, False, True),
    "ASSIGNS_VALUE": ("composition", True, True, False, True), "ARG": ("composition", True, False, True, True), "FIELD": ("composition", True, False, True, True),
    "ON_RECEIVER": ("composition", True, True, False, True), "YIELDS_VALUE": ("composition", True, True, False, True), "RESULT": ("composition", True, True, False, True),
    "VALUE": ("composition", True, True, False, True), "OPERAND": ("composition", True, True, False, True), "LEFT_OPERAND": ("composition", True, True, False, True),
    "RIGHT_OPERAND": ("composition", True, True, False, True),
}

#: Kinds of entities by their labels, the first match counts; those before what an entity says of itself.
STRONG_KINDS = (("Fn", "Callable"),)
STRONG_KINDS_AFTER_OWN_WORK = (("FnDeclaration", "Callable"), ("Call", "CallSite"), ("Request", "CallSite"), ("Op", "CallSite"), ("PredicateCall", "CallSite"))
#: Those after it; a flow block has both of its labels.
WEAK_KINDS = (
    ("Loop", "Loop"), ("Primitive", "ExecutionPrimitive"), ("Step", "Step"), ("ValueAccess", "ValueUse"), ("ValueSlot", "Binding"), ("Storage", "StorageCell"),
    ("Cell", "StorageCell"), ("Setting", "StorageCell"), ("File", "Module"), ("Package", "Module"), ("External", "ExternalComponent"), ("UiSurface", "UiSurface"),
    ("DetachedAsyncCall", "AsyncFlow"), ("AwaitedAsyncCall", "AsyncFlow"),
)
FLOW_BLOCK = ("Flow", "Block")
#: Kinds that an entity says of itself and that count first of all.
OWN_KINDS = ("Projection", "SelectedMember", "MemberProjection")
#: Labels of declarations of types, and those of what runs; with the first alone an entity has no kind.
TYPE_LABELS = ("TypeReference", "TypeDeclaration", "TypeAliasDeclaration", "AliasDeclaration", "TypeMember")
CODE_LABELS = ("ValueSlot", "ValueDeclaration", "Parameter", "Fn", "FunctionImplementation", "CallableDeclaration", "Component")
#: What a developer defined is an entity of its own with one of these labels.
DEFINED, DEFINED_LABELS = "DeveloperDefined", ("Parameter", "ValueDeclaration", "FunctionImplementation", "Component")
HIDDEN = ("VisualProxy", "PresentationOnly")

#: Modules that come with the runtime.
BUILTIN = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs",
    "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream",
    "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)


def first_match(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The result of the first rule that holds; null conditions don't."""
    out = None
    for condition, result in rules:
        out = F.when(condition, result) if out is None else out.when(condition, result)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def has_any(labels: str, wanted) -> Column:
    return F.coalesce(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in wanted])), F.lit(False))


def has_all(labels: str, wanted) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(x) for x in wanted]), labels)) == 0, F.lit(False))


def kind_of(labels: str, explicit: str) -> Column:
    """The kind of an entity: none for presentation and for mere types, else what its labels say before and after what it
    says itself. An empty ``explicit`` says nothing."""
    own = F.nullif(F.col(explicit), F.lit(""))
    table = lambda kinds: [(has_any(labels, [label]), F.lit(kind)) for label, kind in kinds]
    nothing = F.lit(None).cast("string")
    rules = [
        (has_any(labels, HIDDEN), nothing),
        (own.isin(*OWN_KINDS), own),
        (has_any(labels, TYPE_LABELS) & ~has_any(labels, CODE_LABELS), nothing),
        *table(STRONG_KINDS),
        (has_any(labels, [DEFINED]) & has_any(labels, DEFINED_LABELS), F.lit("FunctionalEntity")),
        *table(STRONG_KINDS_AFTER_OWN_WORK),
        (own.isNotNull(), own),
        (has_all(labels, FLOW_BLOCK), F.lit("FlowBlock")),
        *table(WEAK_KINDS),
    ]
    return first_match(rules)


def edge_roles(rel_type: str) -> Column:
    """The roles of a relationship type, in order; ``Data`` alone for types without one."""
    roles = F.array_compact(F.array(*[F.when(F.col(rel_type).isin(*kinds), role) for role, kinds in ROLES.items()]))
    return F.when(F.size(roles) > 0, roles).otherwise(F.array(F.lit("Data")))


def role_kind(rel_type: str, role: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROLES[role].items() for x in pair])
    return F.element_at(table, F.coalesce(F.col(rel_type), F.lit("")))


def policy_table(spark) -> DataFrame:
    """rel_type and the policy fields; of fixed size."""
    rows = [(t, *p) for t, p in POLICY.items()]
    return spark.createDataFrame(rows, "rel_type string, annotation_use string, flow_traversal boolean, flow_visible boolean, flow_composition boolean, functional_visible boolean")


def with_policy(rows: DataFrame) -> DataFrame:
    """With the policy fields of ``rel_type``, the defaults for types without their own."""
    joined = rows.join(F.broadcast(policy_table(rows.sparkSession).withColumn("_known", F.lit(True))), "rel_type", "left")
    fill = [F.when(F.col("_known"), F.col(f)).otherwise(F.lit(v)).alias(f) for f, v in zip(POLICY_FIELDS, POLICY_DEFAULT)]
    return joined.select(*rows.columns, *fill)


def package_name(specifier: str) -> Column:
    """The package of a module specifier: two parts where scoped; none for relative paths and built-in modules."""
    text = F.trim(specifier)
    parts = F.filter(F.split(text, "/"), lambda x: x != "")
    scoped = text.startswith("@")
    name = F.when(scoped, F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, 0), F.get(parts, 1)))).otherwise(F.get(parts, 0))
    outside = (text == "") | text.startswith(".") | text.startswith("/") | text.startswith("node:") | F.when(scoped, text).otherwise(F.get(parts, 0)).isin(*BUILTIN)
    return F.when(~outside, name)


def folder_surface(path: str, depth: int = 3) -> Column:
    """The first ``depth`` folders of a file's path; a path of one part is itself."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    folders = F.when(F.size(parts) <= 1, parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))))
    return F.array_join(F.slice(folders, 1, depth), "/")


def size_class(lines: str, steps: str, stages: str) -> list[Column]:
    """size_class (``large`` if any limit is reached, else ``small``) and its reasons."""
    reasons = F.array_compact(F.array(F.when(F.col(lines) >= 120, "lines"), F.when(F.col(steps) >= 60, "steps"), F.when(F.col(stages) > 1, "stages")))
    return [F.when(F.size(reasons) > 0, "large").otherwise("small").alias("size_class"), reasons.alias("reasons")]


def string_list(c: str) -> Column:
    """A list from a JSON list, or from words between white space and commas; empty for null and blank."""
    text = F.trim(F.coalesce(F.col(c), F.lit("")))
    as_json = F.from_json(text, "array<string>")
    words = F.filter(F.split(text, r"[\s,]+"), lambda x: x != "")
    return F.when(text.startswith("["), F.coalesce(as_json, F.array(text))).otherwise(words)

#: How collection methods iterate: mode, result, short_circuit, reverse, mutates_receiver, item_parameter,
#: callback_action.
COLLECTION_METHODS = {
    "filter": ("select", "collection", False, False, False, 0, "accept"),
    "map": ("transform", "collection", False, False, False, 0, "emit"),
    "flatMap": ("transform", "collection", False, False, False, 0, "emit"),
    "find": ("search", "element", True, False, False, 0, "match"),
    "findLast": ("search", "element", True, True, False, 0, "match"),
    "findIndex": ("search", "index", True, False, False, 0, "match"),
    "findLastIndex": ("search", "index", True, True, False, 0, "match"),
    "some": ("quantify", "boolean", True, False, False, 0, "decide"),
    "every": ("quantify", "boolean", True, False, False, 0, "decide"),
    "reduce": ("accumulate", "accumulator", False, False, False, 1, "accumulate"),
    "reduceRight": ("accumulate", "accumulator", False, True, False, 1, "accumulate"),
    "forEach": ("consume", "void", False, False, False, 0, "effect"),
    "sort": ("compare", "receiver", False, False, True, 0, "order"),
    "toSorted": ("compare", "collection", False, False, False, 0, "order"),
}
METHOD_SCHEMA = "method string, mode string, result string, short_circuit boolean, reverse boolean, mutates_receiver boolean, item_parameter int, callback_action string"


def collection_methods(spark) -> DataFrame:
    """The table of collection methods; of fixed size."""
    return spark.createDataFrame([(m, *v) for m, v in COLLECTION_METHODS.items()], METHOD_SCHEMA)
