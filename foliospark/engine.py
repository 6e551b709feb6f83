"""The engine: parse, validate, transform, render and format tables of documents.

    engine = Engine(spark, configure("tags: {callout: {render: aside}}"))
    engine.render(docs).select("doc_id", "html")

Every method takes a table with a source column and returns a table; nothing is collected and no
order is promised (sort by the id columns where it matters).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import sql
from foliospark.kernel.build import ParseOptions
from foliospark.kernel.format import FormatOptions
from foliospark.kernel.render import HTML, Renderer
from foliospark.kernel.schema import Config
from foliospark.operators.kernels import Kernels
from foliospark.operators.nodes import NUMBER, numbered, parse_nodes
from foliospark.operators.renderables import transform_documents
from foliospark.plans.branches import select_branches
from foliospark.plans.partials import with_partial_table
from foliospark.plans.render import render_nodes
from foliospark.plans.validate import READ, validate_nodes
from foliospark.sources.documents import with_partials


def _texts(value) -> Iterator[str]:
    """All texts inside a value."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict | list | tuple):
        for x in value.values() if isinstance(value, dict) else value:
            yield from _texts(x)


class Engine:
    """One configuration at work; the configuration is broadcast when it is first used."""

    def __init__(self, spark: SparkSession, config: Config | None = None, options: ParseOptions | None = None, formatting: FormatOptions | None = None, renderer: Renderer = HTML):
        self.spark, self.config, self.options = spark, config or Config(), options or ParseOptions()
        self.formatting = formatting or FormatOptions(allow_comments=self.options.allow_comments)
        self.renderer = renderer
        self._kernels: Kernels | None = None

    @property
    def kernels(self) -> Kernels:
        if self._kernels is None:
            self._kernels = Kernels(self.spark, self.config, self.options, self.renderer, self.formatting)
        return self._kernels

    def with_partials(self, texts: dict[str, str]) -> Engine:
        return Engine(self.spark, with_partials(self.config, texts, self.options), self.options, self.formatting, self.renderer)

    def with_options(self, **changes) -> Engine:
        return Engine(self.spark, self.config, replace(self.options, **changes), self.formatting, self.renderer)

    def numbered(self, df: DataFrame) -> DataFrame:
        """The documents with the number that their nodes, problems and HTML carry."""
        return numbered(df)

    def parse(self, df: DataFrame, id_col: str = "doc_id", source: str = "source", file: str | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
        """The flat node table, or those of its columns that are wanted."""
        return parse_nodes(df, id_col, source, file, self.options, columns=columns)

    def validate(self, df: DataFrame, id_col: str = "doc_id", source: str = "source", file: str | None = None) -> DataFrame:
        """Every problem: by the relational plan where the configuration is data, else by the kernel."""
        if self.config.is_relational:
            return validate_nodes(self.parse(df, id_col, source, file, READ), self.config, id_col)
        return self.validate_by_kernel(df, id_col, source, file)

    def validate_by_kernel(self, df: DataFrame, id_col: str = "doc_id", source: str = "source", file: str | None = None, variables: str | None = None) -> DataFrame:
        """Problems numbered by document; `pos` orders them and `node_id` is null."""
        label = None if file is None else F.col(file)
        given = [NUMBER] if NUMBER in df.columns else []
        found = df.select(id_col, *given, F.posexplode(self.kernels.problems(F.col(source), None if variables is None else F.col(variables), label)).alias("pos", "p"))
        error = F.col("p.error")
        return found.select(id_col, *given, F.lit(None).cast("int").alias("node_id"), "pos", "p.type", F.lit(None).cast("string").alias("name"), "p.lines", "p.loc", error["id"].alias("error_id"), error["level"].alias("level"), error["message"].alias("message"))

    def transform(self, df: DataFrame, id_col: str = "doc_id", source: str = "source", variables: str | None = None) -> DataFrame:
        """The renderable node table."""
        return transform_documents(df, self.config, id_col, source, variables, self.options)

    def render(self, df: DataFrame, source: str = "source", variables: str | None = None, html: str = "html") -> DataFrame:
        """The table with its documents' HTML; rows stay where they are."""
        return df.withColumn(html, self.kernels.html(F.col(source), None if variables is None else F.col(variables)))

    def render_with_partials(self, df: DataFrame, partials: DataFrame, source: str = "source", variables: str | None = None, html: str = "html", file: str = "file", text: str = "source") -> DataFrame:
        """The table with its documents' HTML, partials coming from a table (name, text) of any size."""
        names = tuple(sorted(set(_texts(self.config.variables))))
        rows = with_partial_table(df, partials, source, variables, file, text, names, "__partials")
        own = None if variables is None else F.col(variables)
        return rows.withColumn(html, self.kernels.html_with(F.col(source), F.col("__partials"), own)).drop("__partials")

    def render_relational(self, df: DataFrame, id_col: str = "doc_id", source: str = "source", variables: str | None = None) -> DataFrame:
        """(id, html), a row a document, by the ordered aggregate over the renderable table."""
        return render_nodes(self.transform(df, id_col, source, variables), id_col).drop(NUMBER)

    def select_branches(self, nodes: DataFrame) -> DataFrame:
        """The node table without the branches of conditionals that do not hold."""
        return select_branches(nodes, self.config)

    def format(self, df: DataFrame, source: str = "source", formatted: str = "formatted") -> DataFrame:
        """The table with (text, changed, settled) of each document's canonical source."""
        return df.withColumn(formatted, self.kernels.formatted(F.col(source)))

    def ast_json(self, df: DataFrame, source: str = "source", file: str | None = None, column: str = "ast") -> DataFrame:
        return df.withColumn(column, self.kernels.ast_json(F.col(source), None if file is None else F.col(file)))

    def renderable_json(self, df: DataFrame, source: str = "source", variables: str | None = None, column: str = "renderable") -> DataFrame:
        return df.withColumn(column, self.kernels.renderable_json(F.col(source), None if variables is None else F.col(variables)))

    def register(self) -> None:
        """The engine's functions under SQL names."""
        sql.register(self.spark, self.config, self.options, self.formatting)
