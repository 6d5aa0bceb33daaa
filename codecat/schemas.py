"""The symbol catalogue in normal form.

One DataFrame per record kind; operators take a ``Catalog`` (or single
frames) and return DataFrames, so a catalogue extracted from Go text and
one bound from other tables run through the same code.

Columns (``line`` is int for extracted code, long for bound tables).  A catalogue of
several repositories has ``repo`` in every table: a package is known by (repo, package),
and look-ups answer per repository.  One without ``repo`` is that of a single root.

    packages (package, name, dir, module, files array<string>)
    funcs    (package, name, receiver, signature, doc, body, file, line)
    types    (package, name, kind, doc, file, line; of extracted code also
              underlying: the text of the type it is defined over,
              alias_repo, alias_package, alias_type, alias_pointer: what an
              alias names,
              complete: no part of its method set lies outside the catalogue,
              terms array<array<string>>: of an interface, the type terms of
              each of its lines, all of which a type has to meet)
    methods  (package, type_name, name, receiver, ptr_receiver, signature,
              sig_key, is_promoted, doc, body, file, line)
    vars     (package, name, type, is_const, doc, file, line)
    fields   (package, type_name, ordinal, name, type, tag, comment)
    embeds   (package, type_name, ordinal, embed, is_pointer,
              target_package, target_type)
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PACKAGES = T.StructType([
    T.StructField("package", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("dir", T.StringType()),
    T.StructField("files", T.ArrayType(T.StringType())),
])

FUNC_COLS = ["package", "name", "receiver", "signature", "doc", "body", "file", "line"]
TYPE_COLS = ["package", "name", "kind", "doc", "file", "line"]
METHOD_COLS = ["package", "type_name", "name", "receiver", "ptr_receiver", "signature",
               "sig_key", "is_promoted", "doc", "body", "file", "line"]
VAR_COLS = ["package", "name", "type", "is_const", "doc", "file", "line"]
FIELD_COLS = ["package", "type_name", "ordinal", "name", "type", "tag", "comment"]
EMBED_COLS = ["package", "type_name", "ordinal", "embed", "is_pointer", "target_package", "target_type"]

# Run-log schema (S7): the JSON a session runner writes per run.
RUN_LOG = T.StructType([
    T.StructField("usage", T.StructType([
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cache_read_input_tokens", T.LongType()),
        T.StructField("cache_creation_input_tokens", T.LongType()),
    ])),
    T.StructField("total_cost_usd", T.DoubleType()),
    T.StructField("permission_denials", T.ArrayType(T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])


@dataclass(frozen=True)
class Catalog:
    packages: DataFrame
    funcs: DataFrame
    types: DataFrame
    methods: DataFrame
    vars: DataFrame
    fields: DataFrame | None = field(default=None)
    embeds: DataFrame | None = field(default=None)
    # The stored index of find_symbol (operators/symbol_index.py); all four or none.
    symbols: DataFrame | None = field(default=None)
    symbol_names: DataFrame | None = field(default=None)
    symbol_grams: DataFrame | None = field(default=None)
    symbol_freqs: DataFrame | None = field(default=None)
    # Of a stored catalogue: how many folders its tables are dealt over by package (operators/pruning.py).
    buckets: int | None = field(default=None)

    @property
    def scope(self) -> list[str]:
        """The key columns beside ``package``: the repository, where the catalogue holds several."""
        return ["repo"] if "repo" in self.packages.columns else []

    def with_(self, **kw) -> "Catalog":
        return replace(self, **kw)
