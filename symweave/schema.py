"""Schemas of the graph tables and the values that their columns may take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

# Node kinds, edge kinds and languages.
NODE_KINDS = (
    "file", "module", "class", "struct", "interface", "trait", "protocol", "function", "method", "property", "field",
    "variable", "constant", "enum", "enum_member", "type_alias", "namespace", "parameter", "import", "export", "route", "component",
)
EDGE_KINDS = ("contains", "calls", "imports", "exports", "extends", "implements", "references", "type_of", "returns", "instantiates", "overrides", "decorates")
LANGUAGES = (
    "typescript", "javascript", "tsx", "jsx", "python", "go", "rust", "java", "c", "cpp", "csharp", "php",
    "ruby", "swift", "kotlin", "dart", "svelte", "vue", "liquid", "pascal", "scala", "lua", "luau", "unknown",
)
#: Kinds whose members count as part of them.
CONTAINERS = ("class", "interface", "struct", "trait", "protocol", "module", "enum")


def _fields(spec: str) -> StructType:
    return StructType([StructField(name, {"s": StringType(), "i": IntegerType(), "l": LongType(), "b": BooleanType(), "a": ArrayType(StringType())}[kind], True) for name, kind in (x.split(":") for x in spec.split())])


NODES = _fields(
    "id:s kind:s name:s qualified_name:s file_path:s language:s start_line:i end_line:i start_column:i end_column:i docstring:s signature:s visibility:s "
    "is_exported:b is_async:b is_static:b is_abstract:b decorators:a type_parameters:a updated_at:l"
)
METADATA = StructType([StructField("confidence", DoubleType()), StructField("resolved_by", StringType())])
EDGES = StructType([*_fields("edge_id:l source:s target:s kind:s").fields, StructField("metadata", METADATA), *_fields("line:i col:i provenance:s").fields])
ISSUE = _fields("message:s file_path:s line:i column:i severity:s code:s")
FILES = StructType([*_fields("path:s content_hash:s language:s size:l modified_at:l indexed_at:l node_count:i").fields, StructField("errors", ArrayType(ISSUE))])
REFS = _fields("ref_id:l from_node_id:s reference_name:s reference_kind:s line:i col:i candidates:a file_path:s language:s")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """df with exactly the schema's columns: missing ones are null, others go."""
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that have an id, kind, name, file and language."""
    present = F.lit(True)
    for name in ("id", "kind", "name", "file_path", "language"):
        present &= F.col(name).isNotNull() & (F.col(name) != "")
    return nodes.filter(present & F.col("kind").isin(*NODE_KINDS))


def node_id(kind, path, name, line):
    """The id of a symbol: its kind and a digest of where it stands."""
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", path, kind, name, line), 256), 1, 32))
