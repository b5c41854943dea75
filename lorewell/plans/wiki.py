"""A collection of notes and all that can be asked of it, as lazy DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell.operators import duplicates, graph, lengths, lint, parse, resolve, rewrite, wanted
from lorewell.session import Scratch, table


class Wiki:
    """Vaults of notes, from a table of files (page_id, vault, rel_file, content, received_at).

    ``nested`` resolves links by path as well as by name. Each property is a plan; what
    loops or many plans read is written to the shared folder once.
    """

    def __init__(self, files: DataFrame, nested: bool = False):
        self.spark = files.sparkSession
        self.files, self.nested = files, nested
        self.scratch = Scratch(self.spark)

    @classmethod
    def of_tables(cls, spark: SparkSession, folder: str) -> Wiki:
        return cls(table(spark, folder, "files"))

    @cached_property
    def pages(self) -> DataFrame:
        return parse.latest(self.files)

    @cached_property
    def parsed(self) -> DataFrame:
        return self.scratch.save(parse.notes(self.pages, self.nested))

    @cached_property
    def documents(self) -> DataFrame:
        return self.parsed.select("page_id", "vault", "rel_path", "name", "key", "excerpt")

    @cached_property
    def front_matter(self) -> DataFrame:
        return self.parsed.select("page_id", "present", "body_offset", "title", "aliases")

    @cached_property
    def links(self) -> DataFrame:
        found = parse.links_of(self.parsed)
        if not self.nested:
            return resolve.resolve_flat(found, self.documents)
        from lorewell.functions.names import key_column

        paths = self.documents.select(F.col("page_id").alias("src_page"), F.col("rel_path").alias("src_path"))
        based = self.documents.withColumn("base_key", key_column(F.element_at(F.split("rel_path", "/"), -1)))
        return resolve.resolve_nested(found.join(paths, "src_page"), based).drop("src_path")

    @cached_property
    def link_only_lines(self) -> DataFrame:
        return parse.link_only_of(self.parsed)

    @cached_property
    def edges(self) -> DataFrame:
        return self.scratch.save(resolve.edges(self.links))

    @cached_property
    def neighbours(self) -> DataFrame:
        return self.scratch.save(resolve.neighbours(self.edges))

    @cached_property
    def components(self) -> DataFrame:
        return self.scratch.save(graph.components(self.neighbours, self.scratch))

    @cached_property
    def statistics(self) -> DataFrame:
        return parse.statistics(self.pages)

    @cached_property
    def sizes(self) -> DataFrame:
        return parse.sizes(self.files)

    @cached_property
    def fingerprints(self) -> DataFrame:
        return parse.fingerprints(self.statistics)

    def duplicate_keys(self) -> DataFrame:
        return resolve.duplicate_keys(self.documents)

    def check(self) -> Wiki:
        """``ValueError`` if two documents of a vault share a key."""
        twice = self.duplicate_keys().orderBy("vault", F.lower("rel_path")).head(1)
        if twice:
            raise ValueError(f'duplicate document names "{twice[0]["rel_path"]}" in "{twice[0]["vault"]}"')
        return self

    #: Tables that ``register_views`` makes known to SQL.
    VIEWS = ("documents", "front_matter", "links", "link_only_lines", "edges", "neighbours", "components", "statistics", "sizes", "fingerprints")

    def register_views(self, prefix: str = "wiki_") -> list[str]:
        """Temporary views of this collection's tables, so that ``spark.sql`` works over them; returns their names."""
        for name in self.VIEWS:
            getattr(self, name).createOrReplaceTempView(prefix + name)
        return [prefix + name for name in self.VIEWS]

    def find(self, identifier: str, vault: str) -> int:
        from lorewell.functions.names import path_key

        if self.nested:
            own = self.documents.where((F.col("vault") == vault) & (F.col("key") == path_key(identifier))).head(1)
            if own:
                return own[0]["page_id"]
        return resolve.lookup(self.documents, self.front_matter, identifier, vault)

    def outgoing(self) -> DataFrame:
        return resolve.outgoing(self.links, self.documents)

    def incoming(self) -> DataFrame:
        names = self.documents.select(F.col("page_id").alias("src"), F.col("name").alias("source_name"))
        return self.edges.join(names, "src").select("vault", F.col("dst").alias("page_id"), "source_name")

    def orphans(self) -> DataFrame:
        return graph.orphans(self.documents, self.neighbours)

    def component_sizes(self) -> DataFrame:
        return graph.component_sizes(self.documents, self.components, self.scratch)

    def component_members(self) -> DataFrame:
        return graph.members(self.documents, self.components, self.component_sizes())

    def islands(self) -> DataFrame:
        return self.component_members().where("place > 1")

    def lint(self) -> DataFrame:
        return lint.summary(self.documents, self.neighbours, self.link_only_lines, self.components)

    def paths(self, pairs: DataFrame) -> DataFrame:
        return graph.shortest(self.neighbours, self.documents, pairs, True, self.scratch)

    def largest(self) -> DataFrame:
        """(vault, page_id, name, place) of each vault's largest component, in the order of names."""
        return resolve.ordered(graph.largest_members(self.documents, self.components), self.scratch).select("vault", "page_id", "name", "place")

    def sampled_pairs(self, samples: int, seed: int = 1) -> DataFrame:
        return graph.sampled_pairs(self.largest(), samples, seed)

    def sampled_distances(self, samples: int, seed: int = 1, paths: bool = False) -> DataFrame:
        pairs = self.scratch.save(self.sampled_pairs(samples, seed))
        found = graph.shortest(self.neighbours, self.documents, pairs, paths, self.scratch)
        return found.join(pairs, ["source", "target"])

    def wanted(self) -> DataFrame:
        return wanted.wanted_pages(self.links, self.documents)

    def wanted_ranking(self, limit: int | None = None) -> DataFrame:
        return wanted.ranked(self.wanted(), limit, self.scratch)

    def wanted_sources(self) -> DataFrame:
        return wanted.wanted_sources(self.links, self.documents)

    def long_pages(self, **options) -> DataFrame:
        return lengths.long_pages(self.sizes, **options)

    def short_pages(self, **options) -> DataFrame:
        return lengths.short_pages(self.sizes, **options)

    def near_duplicates(self, **options) -> DataFrame:
        prints = self.scratch.save(self.fingerprints)
        return duplicates.near_duplicates(prints, **options)

    def formatted(self) -> DataFrame:
        return rewrite.formatted(self.pages)

    def renamed(self, identifier: str, wanted_name: str, vault: str) -> DataFrame:
        page = self.find(identifier, vault)
        old = self.documents.where(F.col("page_id") == page).head(1)[0]["name"]
        here = self.pages.where(F.col("vault") == vault)
        from lorewell.functions.rewriting import renamed_path

        if page is not None:
            file = here.where(F.col("page_id") == page).head(1)[0]["rel_file"]
            target = renamed_path(file, wanted_name, self.nested) + ".md"
            if target != file and here.where(F.col("rel_file") == target).head(1):
                raise ValueError(f'document "{target[:-3]}" already exists')
        return rewrite.renamed(here, page, old, wanted_name, self.nested)
