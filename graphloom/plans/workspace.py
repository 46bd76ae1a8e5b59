"""The workspace: tables of one code base and the named queries over them, each returning a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, paths
from ..functions.paths import test_path
from ..operators import adjacency, build, diagnostics, facts, graph, intervals, markup, overlay, render, trigrams
from ..sources import snapshot, text
from ..storage import materialize
from . import change, export, impact, steps, symbols


class Workspace:
    """Tables by name: nodes, edges, files, diagnostics, symbols, occurrences, definitions, hovers, projects, and those that a graph is
    built from; those that a query needs must be there.

    Compiler facts (symbols, occurrences, relations, diagnostics) come in as tables; editor services that change code
    or depend on unsaved editor state are no queries and not part of it.
    """

    def __init__(self, **tables: DataFrame):
        self.tables, self.stored_edges, self.stored_names = tables, None, {}

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(f"this workspace has no table {name}") from None

    def stop(self) -> None:
        for df in self.tables.values():
            df.unpersist()
        self.tables, self.stored_edges, self.stored_names = {}, None, {}

    # diagnostics
    def workspace_diagnostics(self, minimum: str = "WARNING", documents: int = 20, per_document: int = 10, **exclude) -> DataFrame:
        rows = diagnostics.filtered(self.diagnostics, minimum, **exclude)
        top = diagnostics.top_documents(rows, documents)
        return diagnostics.top_per_document(rows.join(top.select("uri"), "uri", "left_semi"), per_document, "message").join(top, "uri")

    def diagnostic_totals(self, minimum: str = "WARNING", **exclude) -> DataFrame:
        return diagnostics.totals(diagnostics.filtered(self.diagnostics, minimum, **exclude))

    def document_diagnostics(self, uri: str, first_line: int | None = None, last_line: int | None = None) -> DataFrame:
        """Of one document, or of a range of its lines (what fixes for these lines concern)."""
        rows = self.diagnostics.where(F.col("uri") == uri)
        rows = rows if first_line is None else diagnostics.within_lines(rows, first_line, first_line if last_line is None else last_line)
        return rows.orderBy("start_line", "start_char", "message")

    # symbols
    def document_symbols(self, path: str) -> DataFrame:
        return self.symbols.where(F.col("path") == path).orderBy("start_line", "start_char", "id")

    def symbol_tree(self, path: str) -> DataFrame:
        """The symbols of a document with depth and descendants (all below them); both are null on a cycle of parents."""
        own = self.symbols.where(F.col("path") == path)
        labels = intervals.label(own.select("id", "parent_id")).select("id", "depth", (F.col("size") - 1).alias("descendants"))
        return own.join(labels, "id").orderBy("start_line", "start_char", "id")

    def definition(self, path: str, line: int, character: int) -> DataFrame:
        """Definitions of the symbol whose occurrence holds the position."""
        at = self.occurrences.where((F.col("path") == path) & (F.col("line") == line) & F.lit(character).between(F.col("start_char"), F.col("end_char")))
        return self.definitions.join(at.select("symbol_id").distinct(), "symbol_id", "left_semi")

    def references(self, symbol_id: str) -> DataFrame:
        return self.occurrences.where(F.col("symbol_id") == symbol_id).orderBy("path", "line", "start_char")

    def hover(self, path: str, line: int, character: int) -> DataFrame:
        return symbols.hover(self.hovers, path, line, character)

    def search_symbols(self, query: str, k: int = 50) -> DataFrame:
        return symbols.ranked(symbols.search(self._named("symbols", symbols.search_key(query).rstrip(".").rsplit(".", 1)[-1]), query)).limit(max(1, k))

    def store_names(self, path: str) -> None:
        """Stores nodes and symbols, those that there are, with an index of their names below path; searches and the targets of a change
        use it from now on, until the graph is built or loaded again."""
        for table, columns in (("nodes", ["documentation_id", "metadata_name", "display_name"]), ("symbols", ["container_name", "name"])):
            if table in self.tables:
                trigrams.store(self.tables[table], f"{path}/{table}", columns)
                self.stored_names[table] = f"{path}/{table}"

    def _named(self, table: str, query: str) -> DataFrame:
        """The rows of the table, or those that may hold the query, where the names are stored."""
        own = getattr(self, table)
        return trigrams.may_hold(own.sparkSession, self.stored_names[table], query) if table in self.stored_names else own

    def _forget_graph(self) -> None:
        """The stored forms of a graph that was replaced."""
        self.stored_edges = None
        self.stored_names.pop("nodes", None)

    def analyze_symbol(self, query: str | None = None, path: str | None = None, line: int = -1, character: int = -1, k: int = 20) -> DataFrame:
        """Sections of all that is known of the symbol at a position or of the best answer to a query; no row where there is none."""
        own = materialize(symbols.resolve(self.symbols, query, path, line, character), "symbol")
        rows = facts.lines(self.files) if "files" in self.tables else None
        return symbols.analyze(own, self.nodes, self.edges, self.definitions, self.occurrences, rows, k)

    def semantic_search(self, mode: str) -> DataFrame:
        return facts.semantic_search(self.files, mode)

    # hierarchies
    def _one(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def store_edges(self, path: str) -> None:
        """Stores the edges by both ends below path; the hierarchies and the sections of a change look them up there from now on, until the graph is built or loaded again."""
        adjacency.store(self.edges, path)
        self.stored_edges = path

    def _neighbors(self, node_id: str, kinds: list[str], incoming: bool) -> DataFrame:
        return graph.neighbors(self._links(), self.nodes, self._one(node_id), kinds, incoming)

    def _links(self) -> DataFrame | adjacency.Stored:
        return adjacency.Stored(self.nodes.sparkSession, self.stored_edges) if self.stored_edges else self.edges

    def implementations(self, node_id: str) -> DataFrame:
        return self._neighbors(node_id, ["implements", "inherits"], incoming=True)

    def call_hierarchy(self, node_id: str) -> DataFrame:
        calls = [self._neighbors(node_id, ["calls"], i).withColumn("incoming", F.lit(i)) for i in (True, False)]
        return calls[0].unionByName(calls[1])

    def type_hierarchy(self, node_id: str) -> DataFrame:
        links = [self._neighbors(node_id, ["implements", "inherits"], i).withColumn("subtype", F.lit(i)) for i in (True, False)]
        return links[0].unionByName(links[1])

    def containment(self) -> DataFrame:
        """The labels of the contains edges (see operators.intervals); give them to containers and contents, so that they are made once."""
        return intervals.label(self.edges.where("kind = 'contains'").select(F.col("target_id").alias("id"), F.col("source_id").alias("parent_id")))

    def containers(self, node_id: str, labels: DataFrame | None = None) -> DataFrame:
        """The nodes that hold a node, with distance, the nearest first."""
        found = intervals.above(self.containment() if labels is None else labels, self._one(node_id))
        return self.nodes.join(found.drop("seed_id"), "id").orderBy("distance", "id")

    def contents(self, node_id: str, max_depth: int | None = None, labels: DataFrame | None = None) -> DataFrame:
        """The nodes within a node, with distance."""
        found = intervals.below(self.containment() if labels is None else labels, self._one(node_id), max_depth)
        return self.nodes.join(found.drop("seed_id"), "id").orderBy("distance", "id")

    # architecture
    def project_overview(self) -> DataFrame:
        """Each project with its type, the projects that refer to it, and its first entrypoint files."""
        own = text.read_projects(self.files)
        users = own.select(F.col("name").alias("user"), F.explode("references").alias("name")).groupBy("name").agg(F.array_sort(F.collect_set("user")).alias("referenced_by"))
        ids = own.select(F.col("path").alias("project_id"), F.col("name").alias("project_name"), "path")
        found = overlay.entrypoint_files(overlay.with_project(self.files.where(F.lower("path").endswith(".cs")), ids).select("path", "content", "project_id"))
        entries = found.groupBy(F.col("project_id").alias("path")).agg(F.array_sort(F.collect_list(F.struct("kind", F.col("path").alias("file")))).alias("entrypoint_files"))
        return own.join(users, "name", "left").join(entries, "path", "left")

    def project_totals(self) -> DataFrame:
        """Projects by type and framework."""
        own = text.read_projects(self.files)
        return own.select("name", "type", F.explode_outer("frameworks").alias("framework")).groupBy("type", "framework").agg(F.count_distinct("name").alias("projects"))

    def _with_project(self, rows: DataFrame) -> DataFrame:
        """rows with the project whose folder holds their file; where none does, the first folder of the path stands for it."""
        ids = text.read_projects(self.files).select(F.col("path").alias("project_id"), F.col("name").alias("project_name"), "path")
        near = overlay.with_project(rows.select("path").distinct(), ids).select("path", F.col("project_name").alias("project"))
        folder = F.substring_index(paths.normalized(F.col("path")), "/", 1)
        return rows.join(near, "path", "left").withColumn("project", F.coalesce("project", F.when(folder != F.col("path"), folder), F.lit("")))

    def find_entrypoints(self, project: str | None = None) -> DataFrame:
        """category, kind, path, line, text: runnable projects, routes, hosted services, handlers, middleware and start-up calls."""
        rows = facts.lines(facts.source_files(self.files, tests=False))
        hosts = text.read_projects(self.files).where(F.col("type").isin("web", "worker", "lambda", "executable"))
        out = hosts.select(F.col("type").alias("kind"), "path", F.lit(1).alias("line"), F.col("name").alias("text"), F.lit("host_project").alias("category"))
        kinds = (("aspnet_route", facts.routes), ("hosted_service", facts.hosted_services), ("serverless_handler", facts.serverless_handlers), ("middleware", facts.middleware))
        for category, scan in kinds:
            out = out.unionByName(scan(rows).withColumn("category", F.lit(category)))
        calls = facts.startup_calls(rows)
        out = out.unionByName(calls.select(F.col("name").alias("kind"), "path", "line", F.col("name").alias("text"), F.lit("startup_call").alias("category")))
        if project:
            out = out.where(names.contains_ci(F.col("path"), F.lit(project.strip())))
        return out.orderBy("category", names.fold_ci("path"), "line", "kind")

    def endpoint_composition(self) -> DataFrame:
        return facts.endpoint_composition(facts.lines(facts.source_files(self.files, tests=False)))

    def find_registrations(self, query: str | None = None, consumers: bool = False, k: int = 50) -> DataFrame:
        own = facts.source_files(self.files)
        used = self._with_project(facts.consumers(own)) if consumers else None
        return facts.registration_report(self._with_project(facts.registrations(own)), used, query, k).orderBy("place")

    # tests and dead code
    def test_map(self, names: list[str] | None = None, path: str | None = None, query: str | None = None, k: int = 20) -> DataFrame:
        """Test files that concern names, or a file and the types that it declares, or a symbol query and its last name; a path goes before a query.

        A path that isn't there has no names, so no test concerns it.
        """
        tests = facts.source_files(self.files).where(test_path(F.col("path")))
        if path:
            names = [r.name for r in facts.declared_types(self.files, path).collect()]  # of one file
            if not names:
                tests, names = tests.where("false"), [path]
        elif query and query.strip():
            names = sorted({query.strip(), query.strip().split("(")[0].rsplit(".", 1)[-1]} - {""})
        if not names:
            raise ValueError("give names, a file path or a symbol query")
        return facts.test_report(facts.lines(tests), names, k).orderBy("place")

    def dead_code(self) -> DataFrame:
        return facts.dead_code(facts.source_files(self.files, tests=False, short_generated=True)).orderBy("kind", "path", "line", "name")

    # graph
    def graph_stats(self) -> DataFrame:
        return graph.kind_counts(self.nodes).withColumn("of", F.lit("node")).unionByName(graph.kind_counts(self.edges).withColumn("of", F.lit("edge")))

    def save_graph(self, path: str, target: str = "", options: str = "") -> None:
        snapshot.write_snapshot({name: self.tables[name] for name in snapshot.STORED if name in self.tables}, path, target, options)

    def build_code_graph(self, path: str, target: str = "", include_generated: bool = False, incremental: bool = True) -> dict:
        """Builds nodes and edges from the tables source_symbols, places, relations, call_sites, documents, projects (see operators.build)
        and states (fingerprints of the projects), stores them as a snapshot below path, and goes on with them.

        Builds upon the stored snapshot where it is of the same target and options. Returns reason (why not, or None) and the ids of
        the rebuilt and reused projects.
        """
        spark, options = self.source_symbols.sparkSession, f"generated={include_generated}"
        previous = snapshot.read_snapshot(spark, path) if incremental else None
        reason = build.reuse_refused(previous, snapshot.snapshot_info(spark, path), target, options)
        facts_ = {"symbols": self.source_symbols, "occurrences": self.call_sites} | {name: self.tables[name] for name in ("places", "relations", "documents", "projects", "files") if name in self.tables}
        got = build.build_graph(facts_, self.states, None if reason else previous, include_generated)
        snapshot.write_snapshot({name: got[name] for name in snapshot.STORED if name in got}, path, target, options)
        self.tables |= snapshot.read_snapshot(spark, path)
        self._forget_graph()
        rebuilt = sorted(r.id for r in got["rebuilt"].collect())
        every = {r.project_id for r in self.projects.select("project_id").distinct().collect()}
        return {"reason": reason, "rebuilt": rebuilt, "reused": sorted(every - set(rebuilt))}

    def load_graph(self, path: str, target: str = "", include_generated: bool = False) -> bool:
        """Goes on with the stored graph; builds one where there is none or none with calls. False where a graph had to be built."""
        stored = snapshot.read_snapshot(self.source_symbols.sparkSession, path)
        if stored is not None and build.has_calls(stored["edges"]):
            self.tables |= stored
            self._forget_graph()
            return True
        self.build_code_graph(path, target, include_generated, incremental=False)
        return False

    def export_graph(self, query: str | None = None, form: str = "mermaid", max_nodes: int = 80, max_edges: int = 160, **settings) -> DataFrame:
        """The text of a slice around a symbol, of a project, or of the whole (see export.select for the settings)."""
        layouts = {"mermaid": render.mermaid, "dot": render.dot}
        if form.strip().lower() not in layouts:
            raise ValueError(f"unknown layout {form!r}; the layouts are {', '.join(layouts)}")
        nodes, edges, _ = export.select(self.nodes, self.edges, query, max_nodes=max_nodes, max_edges=max_edges, **settings)
        return layouts[form.strip().lower()](nodes, edges)

    # change
    def impact_sections(self, query: str | None = None, path: str | None = None, k: int = 20) -> DataFrame:
        tests = None
        if "files" in self.tables:
            tests = self.test_map(path=path if not query else None, query=query, k=k) if query or path else None
        return impact.sections(self.nodes, self._links(), query, path, k, tests, self._named("nodes", query) if query else None)

    def change_impact(self, query: str | None = None, path: str | None = None, k: int = 20) -> DataFrame:
        return impact.ranked_files(self.impact_sections(query, path, k), k)

    def _projects(self) -> tuple[DataFrame, DataFrame]:
        """The projects (project_id, project_name, path, is_test) and solutions (path): of the table projects, else of the files."""
        solutions = self.files.where(F.lower("path").rlike(r"[.]slnx?$")).select("path") if "files" in self.tables else self.nodes.where("kind = 'Solution'").select(F.col("file_path").alias("path"))
        if "projects" in self.tables:
            own = self.projects.select("project_id", "project_name", "path")
            return own.withColumn("is_test", F.coalesce(paths.test_project(F.col("project_name"), F.col("path")), F.lit(False))), solutions
        return text.read_projects(self.files).select(F.col("path").alias("project_id"), F.col("name").alias("project_name"), "path", "is_test"), solutions

    def plan_change(self, query: str | None = None, path: str | None = None, k: int = 10) -> DataFrame:
        """The steps of a change in order: phase (inspect, edit, verify), step, kind, title, command, targets, truncated."""
        found = materialize(self.impact_sections(query, path, max(20, 3 * k)), "impact")
        return steps.plan(found, self.nodes, *self._projects(), k)

    def impacted_projects(self, query: str | None = None, path: str | None = None, k: int = 20) -> DataFrame:
        """The projects of the table projects that a change reaches."""
        return change.impacted_projects(self.impact_sections(query, path, k), self.nodes, self.projects)

    def impacted_registrations(self, query: str | None = None, path: str | None = None) -> DataFrame:
        """Registrations in the source files that name a target, or whose consumers in the targets' projects do."""
        own = facts.source_files(self.files)
        targets = materialize(impact.resolve_targets(self.nodes, self._links(), query, path, self._named("nodes", query) if query else None), "targets")
        projects = targets.select(F.col("project_name").alias("project")).where("project is not null")
        return facts.registrations_that_concern(self._with_project(facts.registrations(own)), self._with_project(facts.consumers(own)), impact.candidate_names(targets), projects)

    def _impact_or_none(self, changed: DataFrame | None, query: str | None, path: str | None, k: int) -> tuple[DataFrame | None, DataFrame]:
        """The impact, where there is a query or path, and the changed files."""
        if not (query or path) and changed is None:
            raise ValueError("give a symbol query, a file path or changed files")
        found = materialize(self.impact_sections(query, path, max(20, 3 * k)), "impact") if query or path else None
        spark = self.diagnostics.sparkSession if "diagnostics" in self.tables else self.nodes.sparkSession
        return found, spark.createDataFrame([], "path string") if changed is None else changed.select("path")

    def verify_change(self, changed: DataFrame | None = None, query: str | None = None, path: str | None = None, minimum: str = "WARNING", k: int = 10) -> DataFrame:
        """Diagnostics of the changed files (path) and of what a change reaches; of all files where neither names one."""
        return steps.focused_diagnostics(*self._impact_or_none(changed, query, path, k), self.diagnostics, minimum, k)

    def verification_steps(self, changed: DataFrame | None = None, query: str | None = None, path: str | None = None, k: int = 10) -> DataFrame:
        """Builds, tests and diagnostics to run for changed files (path) and for what a change reaches."""
        found, files = self._impact_or_none(changed, query, path, k)
        return steps.verification(found, files, self.nodes if found is not None else None, *self._projects(), k)

    # markup (files that end in .xaml)
    def _elements(self) -> DataFrame:
        return markup.elements(self.files.where(F.lower("path").endswith(".xaml")))

    def markup_issues(self, known_types: DataFrame | None = None) -> DataFrame:
        return markup.issues(self._elements(), known_types)

    def markup_bindings(self) -> DataFrame:
        return markup.bindings(markup.attributes(self._elements()))

    def markup_resources(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Definitions, references, and definitions that nothing refers to."""
        attrs = markup.attributes(self._elements())
        defined, used = markup.resources(attrs), markup.resource_references(attrs)
        return defined, used, markup.unused_resources(defined, used)

    def markup_names(self) -> DataFrame:
        return markup.duplicate_names(markup.named_elements(markup.attributes(self._elements())))

    def markup_structure(self, max_depth: int = 5) -> DataFrame:
        return markup.tree(self._elements(), max_depth)

    def binding_errors(self) -> DataFrame:
        attrs = markup.attributes(self._elements())
        return markup.binding_errors(markup.bindings(attrs), markup.named_elements(attrs), markup.resources(attrs))

    def markup_types(self) -> DataFrame:
        return markup.element_types(self._elements())

    def markup_recovered(self) -> DataFrame:
        """Class, names and bindings, by pattern, of the files that don't parse."""
        broken = self._elements().where("error is not null").select("path").distinct()
        return markup.recovered(self.files.join(broken, "path", "left_semi"))

    def view_model(self, name: str = "IViewModel") -> DataFrame:
        return markup.interface_text(markup.view_model(self.markup_bindings()), name)
