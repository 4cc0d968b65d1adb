"""The query entry points: index a repository, then ask its graph."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.functions import scoring as S
from factloom.functions.text import estimate_tokens, similarity, terms
from factloom.functions.trust import provenance_rank
from factloom.operators import benchmark, components, derive, flows, graph, lookups, search, selection, semantic, store, surface, traces
from factloom.operators.state import State
from factloom.plans import ingest
from factloom.session import cut, prepare
from factloom.sources.scan import scan_repo
from factloom.streaming import epochs

# Default token budgets.
BUDGETS = {"startup": 6000, "task": 10_000, "atlas": 15_000}
TABLES = ("files", "entities", "edges", "evidence")


class Engine:
    """Facts of one repository in Parquet folders below ``folder``; each call reads the tables it needs and returns a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")
        self.state = State(self.spark, f"{self.folder}/state")
        self._words: dict[str, list[str]] = {}

    # tables

    def generation(self) -> str:
        return json.loads(self.spark.read.text(f"{self.folder}/current").first()[0])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.generation()}/{name}")

    def _write(self, frames: dict[str, DataFrame], generation: str) -> None:
        """Write the frames, what the edges rest on, and then the name of the generation, which makes it the current one."""
        at = f"{self.folder}/{generation}"
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{at}/{name}")
        if "evidence" not in frames:
            ingest.evidence_of(self.spark.read.parquet(f"{at}/edges")).write.mode("overwrite").parquet(f"{at}/evidence")
        self.spark.createDataFrame([(json.dumps(generation),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/current")

    def index(self, root: str, ignore: list[str] | None = None, incremental: bool = False) -> DataFrame:
        """Scan, extract, resolve and write all facts; returns the change of each path.

        Incremental runs extract the changed files alone: facts of files that are the
        same are read back. Names are resolved over all facts, so the result is that of a full run.
        """
        files = scan_repo(self.spark, root, ignore)
        old = None
        if incremental:
            old = self.table("files")
            change = store.registry_diff(old, files, "path", "digest")
            fresh = files.join(change.filter("change in ('added', 'changed')").select("path"), "path", "left_semi")
            same = change.filter("change = 'same'").select("path")
            f, c = ingest.extract_all(fresh)
            facts = f.unionByName(self.table("facts").join(same, "path", "left_semi"))
            config = c.unionByName(self.table("config").join(same, "path", "left_semi"))
        else:
            change = files.select("path", F.lit("added").alias("change"))
            facts, config = ingest.extract_all(files)
        generation = f"g{self.spark.sparkContext.applicationId}-{self.spark._jvm.System.nanoTime()}"
        keep = {"files": files.drop("content"), "facts": facts, "config": config, "change": change}
        for name, df in keep.items():
            df.write.parquet(f"{self.folder}/{generation}/{name}")
        read = lambda n: self.spark.read.parquet(f"{self.folder}/{generation}/{n}")
        self._write(ingest.build(read("files"), read("facts"), read("config")), generation)
        return read("change")

    # lookups

    def trusted(self, **policy) -> DataFrame:
        return graph.trusted(self.table("edges"), **policy)

    def status(self) -> DataFrame:
        one = lambda n: self.table(n).agg(F.lit(n).alias("table"), F.count("*").alias("rows"))
        out = one(TABLES[0])
        for n in TABLES[1:]:
            out = out.union(one(n))
        return out

    def search(self, text: str, k: int = 10) -> DataFrame:
        """The k entities that rank best for free text: BM25 over names, signatures and docstrings, then substrings."""
        ents = self.table("entities").withColumn("text", F.concat_ws(" ", F.regexp_replace("name", r"([a-z0-9])([A-Z])", "$1 $2"), "signature", "docstring"))
        words = self._terms(text)
        if not words:
            return ents.limit(0).select("id", F.lit(0.0).alias("score"), F.lit("").alias("reason"), "kind", "name", "path")
        index = search.postings(ents, "id", F.col("text"))
        row = lambda df, score, reason, source: df.select("id", score.alias("score"), F.lit(reason).alias("reason"), F.lit(source).alias("source"), F.lit(0).alias("position"))
        hits = row(search.bm25_any(index, "id", words), F.col("score"), "name", 0)
        hits = hits.unionByName(row(search.like_search(ents, "id", "name", "text", words, k), F.lit(0.6), "substring", 1))
        return search.fuse(hits, k).join(ents.select("id", "kind", "name", "path"), "id").orderBy(F.desc("score"), "id")

    def component(self, prefix: str) -> DataFrame:
        """Symbols below a folder with how many callers and callees they have."""
        own = self.table("entities").filter((F.col("kind") == "symbol") & F.col("path").startswith(prefix)).select("id", "name", "path", "signature")
        calls = self.trusted().filter("predicate = 'calls'")
        up, down = calls.groupBy(F.col("object").alias("id")).agg(F.count_distinct("subject").alias("callers")), calls.groupBy(F.col("subject").alias("id")).agg(F.count_distinct("object").alias("callees"))
        return own.join(up, "id", "left").join(down, "id", "left").na.fill(0, ["callers", "callees"])

    def flow(self, entry: str, depth: int = graph.DEPTH) -> DataFrame:
        """Paths of trusted calls from an entity."""
        e = self.trusted().filter("predicate = 'calls'").select(F.col("subject").alias("src"), F.col("object").alias("dst"), provenance_rank(F.col("provenance")).alias("rank"))
        return graph.bounded_paths(e, self.spark.createDataFrame([(entry,)], "id string"), depth)

    def impact(self, paths: list[str], depth: int = 3) -> DataFrame:
        seeds = self.spark.createDataFrame([(f"file:{p}",) for p in paths], "id string")
        pair = lambda *preds: self.trusted().filter(F.col("predicate").isin(*preds)).select(F.col("subject").alias("src"), F.col("object").alias("dst"))
        return graph.impact(seeds, pair("contains"), pair("calls", "imports", "reads", "writes", "tests"), depth)

    def entity(self, id_: str) -> DataFrame:
        return self.table("entities").filter(F.col("id") == id_)

    def entity_sources(self, id_: str) -> DataFrame:
        """The files that an entity was read from."""
        return lookups.entity_sources(self.table("entities"), self.table("edges")).filter(F.col("id") == id_).select("path")

    def evidence_for(self, path: str) -> DataFrame:
        """Evidence (id, path) that lies in a file."""
        return self.table("evidence").filter(F.col("path") == path)

    def imports_in(self, path: str) -> DataFrame:
        """(name, module, imported, line) of a file's imports."""
        detail = F.from_json("detail", "module string, imported string")
        rows = self.table("facts").filter((F.col("path") == path) & (F.col("family") == "import"))
        return rows.select("name", F.coalesce(detail["module"], "name").alias("module"), detail["imported"].alias("imported"), "line").orderBy("line", "name")

    def tests(self) -> DataFrame:
        """(id, name, path, symbol) of tests and of what each reaches, null if nothing."""
        reached = self.table("edges").filter("predicate = 'tests'").select(F.col("subject").alias("id"), F.col("object").alias("symbol"))
        return self.table("entities").filter("kind = 'test'").select("id", "name", "path").join(reached, "id", "left")

    def runtime_edge_rows(self) -> DataFrame:
        return self.state.read("runtime_edges").orderBy("source", "target")

    # vectors and claims

    def embed(self, model: Callable[[list[str]], list[list[float]]], name: str) -> int:
        """Vectors of all entities of the kinds that get one, by a model (texts -> vectors); returns their number."""
        self.state.merge("embeddings", semantic.embed(semantic.entity_texts(self.table("entities")), model, name), ["id"])
        return self.state.read("embeddings").count()

    def semantic(self, goal: list[float]) -> DataFrame:
        """(id, score) of the stored vectors to a goal's, for ``task(scores=...)``."""
        return semantic.semantic_scores(self.state.read("embeddings"), goal)

    def task_claims(self, pack: DataFrame, claims: DataFrame, source: str) -> str:
        """A task's pack with the claims (position, claim, evidence) of an outside summarizer, which may name the pack's entities and their evidence alone.

        Raises ValueError with the reasons if any claim is without text or names other evidence.
        """
        one = F.lit(0).alias("pack")
        ids = pack.select("id")
        proof = self.table("edges").join(ids.withColumnRenamed("id", "subject"), "subject", "left_semi").select(F.explode("evidence").alias("id"))
        checked = semantic.checked_claims(claims.select(one, "position", "claim", "evidence").withColumnRenamed("position", "at"), ["pack"], F.col("at"), "claim", "evidence", ids.union(proof).select(one, "id"))
        rows = checked.orderBy("position").collect()  # a summary's claims, bounded by what a reader takes
        if wrong := [r for r in rows if r["line"] is None]:
            raise ValueError(f"{len(wrong)} claims rejected: " + "; ".join(f"#{r['position']} " + (f"unknown evidence {r['unknown']}" if r["claim"] else "no text") for r in wrong))
        text = "\n".join(r["text"] for r in pack.orderBy("position").select("text").collect())
        return semantic.claims_text(text, source, [r["line"] for r in rows])

    def links(self) -> DataFrame:
        """(src, dst, weight) of the rank graph; stored for the facts as they are."""
        def build() -> DataFrame:
            ents = self.table("entities")
            edges = self.trusted().join(ents.select(F.col("id").alias("object")), "object", "left_semi")
            return graph.weighted(edges, ents)

        return self.state.cached("links", self.generation(), build)

    def ranks(self, seeds: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
        """(id, rank) of all entities, with a share of what they relate to."""
        links = self.links()
        return graph.project_ranks(graph.pagerank(links, self.table("entities").select("id"), seeds, start), links.select(F.col("src").alias("subject"), F.col("dst").alias("object")))

    def surface(self, k: int = 50) -> DataFrame:
        """The k exported symbols of the best rank."""
        ents = self.table("entities").filter("kind = 'symbol' and exported")
        return self.ranks().join(ents.select("id", "name", "path", "signature"), "id").orderBy(F.desc("rank"), "id").limit(k)

    # ranked context

    def _normal(self, rows: DataFrame, name: str) -> DataFrame:
        """id and ``name``: the ranks over the greatest one."""
        most = F.broadcast(rows.agg(F.max("rank").alias("most")))  # one row
        return rows.join(most).select("id", F.when(F.col("most") > 0, F.col("rank") / F.col("most")).otherwise(0.0).alias(name))

    def global_ranks(self) -> DataFrame:
        """Ranks of all entities, started from exports and handlers; stored for the facts as they are."""
        def build() -> DataFrame:
            seeds = self.table("entities").filter("exported").select("id").union(self.trusted().filter("predicate in ('handles', 'registers', 'publishes')").select(F.col("subject").alias("id"))).distinct()
            n = seeds.count()
            return self.ranks(seeds.withColumn("share", F.lit(1.0 / n)) if n else None)

        return self.state.cached("ranks", f"{self.generation()}:{self.state.epoch()}", build)

    def _items(self, goal: str, files: list[str], symbols: list[str], scores: DataFrame | None, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Candidates for a goal, each with the parts of its importance: hits of the search and what the caller names, whether the search found it or not.

        scores (id, score) replaces the semantic part, in [0, 1].
        """
        ents, edges = self.table("entities"), self.trusted()
        hits = cut(self.search(goal, 120).select("id", "kind", "name", "score"))
        hits = cut(semantic.ranked_again(hits, scorer)) if scorer else hits.select("id", "score")
        named = ents.filter(F.col("path").isin(files or [""]) | F.col("name").isin(symbols or [""])).select("id", F.lit(True).alias("required"))
        ids = hits.select("id").union(named.select("id")).distinct()
        words = F.array(*[F.lit(w) for w in self._terms(goal) or [""]])
        lexical = similarity(words, F.col("name"), F.coalesce("signature", F.lit("")))
        rows = ents.join(ids, "id").join(named, "id", "left").withColumn("lexical", F.least(lexical / F.lit(3.0 * max(1, len(self._terms(goal)))), F.lit(1.0)))
        total = hits.agg(F.sum("score")).first()[0] or 0.0
        seeds = hits.withColumn("share", F.col("score") / total).select("id", "share") if total else None
        every = self.global_ranks()
        task = self.ranks(seeds, every) if seeds is not None else every.withColumn("rank", F.lit(0.0))
        rows = rows.join(self._normal(every, "global_ppr"), "id", "left").join(self._normal(task, "task_ppr"), "id", "left")
        writes = edges.filter("predicate in ('writes', 'handles', 'publishes')").groupBy(F.col("subject").alias("id")).agg(F.count("*").alias("acts"))
        into = edges.groupBy(F.col("object").alias("id")).agg(F.count_distinct("subject").alias("sources"), F.avg("confidence").alias("confidence"))
        rows = rows.join(writes, "id", "left").join(into, "id", "left").na.fill(0, ["acts", "sources"]).na.fill(0.0, ["global_ppr", "task_ppr"]).na.fill(1.0, ["confidence"])
        rows = rows.join(scores.select("id", F.col("score").alias("semantic")), "id", "left").na.fill(0.0, ["semantic"]) if scores is not None else rows.withColumn("semantic", F.lit(0.0))
        return rows.withColumn("required", F.coalesce("required", F.lit(False)))

    def _terms(self, text: str) -> list[str]:
        if text not in self._words:
            self._words[text] = list(self.spark.range(1).select(terms(F.lit(text))).first()[0])
        return self._words[text]

    def task(self, goal: str, files: list[str] | None = None, symbols: list[str] | None = None, budget: int = BUDGETS["task"], scores: DataFrame | None = None, variant: str = "task-ppr", unseen: bool = False, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(id, kind, name, path, importance, tokens, required, text) for a goal within the budget.

        Search gives candidates; their importance blends task and global ranks, words, meaning,
        confidence and risk. What the caller names is always in, rendered shorter if it alone passes the
        hard limit; the rest is diversified by file, held to the shares of its kinds and chosen by value for its tokens. ``variant`` leaves
        stages out; ``unseen`` leaves out what the ledger of this epoch shows. ``scorer`` scores the best hits of the search again.
        """
        on, hard = benchmark.stages(variant), budget + max(-(-budget // 5), 500)
        rows = self._items(goal, files or [], symbols or [], scores, scorer)
        if unseen:
            rows = epochs.unseen(rows.filter("not required"), self.state.read("ledger")).unionByName(rows.filter("required"))
        zero = F.lit(0.0)
        parts = {"task_ppr": F.col("task_ppr") if on["task_ppr"] else zero, "global_ppr": F.col("global_ppr") if on["global_ppr"] else zero, "lexical": F.col("lexical"), "semantic": F.col("semantic"), "confidence": F.col("confidence"), "criticality": F.when(F.col("acts") > 0, 1.0).otherwise(0.0), "change_risk": F.least(F.col("sources") / 20.0, F.lit(1.0)), "novelty": F.lit(1.0)}
        rows = rows.withColumn("importance", F.round(S.final_importance(parts), 9))
        place = F.coalesce("path", F.lit(""))
        text = lambda level: surface.render_entry(F.lit(level), F.col("name"), place, F.col("signature"), F.col("docstring"), F.array().cast("array<string>"))
        rows = rows.withColumn("full", text(1)).withColumn("short", text(3))
        rows = cut(rows)
        must = rows.filter("required").agg(F.coalesce(F.sum(estimate_tokens(F.col("full"))), F.lit(0))).first()[0]
        rows = rows.withColumn("text", F.col("short") if must > hard else F.col("full")).withColumn("tokens", F.greatest(estimate_tokens(F.col("text")), F.lit(1))).withColumn("goal", F.lit(goal))
        pool = rows.filter("not required")
        if on["mmr"]:
            kept = selection.mmr_diversify(pool.select("goal", "id", F.col("importance").alias("score"), place.alias("likeness")), ["goal"], 60)
            pool = pool.join(kept.select("id", "ordinal"), "id")
        else:
            pool = pool.withColumn("ordinal", F.lit(0))
        kind = surface.quota_kind({"exported": F.coalesce("exported", F.lit(False)), "writes": F.col("acts"), "contract": F.col("kind").isin("route", "job", "command"), "flows": F.lit(0), "symbol_kind": F.get_json_object("attributes", "$.symbol_kind")})
        if on["quotas"]:
            shares = selection.enforce_quotas(pool.select("goal", kind.alias("kind"), "id", F.col("tokens").alias("cost"), (-F.col("importance")).alias("position")), ["goal"], budget)
            pool = pool.join(shares.select(F.explode("ids").alias("id")), "id", "left_semi")
        items = rows.filter("required").withColumn("ordinal", F.lit(-1)).unionByName(pool).select("goal", "id", F.col("tokens").alias("cost"), F.col("importance").alias("value"), "required", F.struct((-F.col("importance")).alias("i"), "ordinal").alias("position"))
        chosen = selection.select_with_budget(items, ["goal"], budget, hard, by_density=on["optimizer"])
        out = chosen.select(F.posexplode("ids").alias("position", "id")).join(rows, "id")
        return out.select("position", "id", "kind", "name", "path", "importance", "tokens", "required", "text").orderBy("position")

    def task_text(self, goal: str, budget: int = BUDGETS["task"], scope: list[str] | None = None, **more) -> str:
        """The task's entries as text, under a header that names the scope of a helper."""
        rows = self.task(goal, files=scope, budget=budget, **more)
        comp = F.coalesce(F.regexp_extract(F.coalesce("path", F.lit("")), r"^([^/]*)/", 1), F.lit(""))
        text = surface.render_groups(rows.select(F.when(comp == "", "root").otherwise(comp).alias("component"), F.coalesce("path", F.lit("(no file)")).alias("path"), "position", "text")).first()[0] or ""
        head = f"Scope: {', '.join(scope)}\n\n" if scope else ""
        notes = "".join(f"Warning: {r['message']}\n" for r in self.warnings().collect())
        return head + notes + text

    def show(self, rows: DataFrame) -> None:
        """Record what has been shown, so that a later task can leave it out."""
        self.state.replace("ledger", epochs.record_visible(self.state.read("ledger"), rows, self.state.epoch()))

    def structural(self, files: list[str], deep: list[str] | None = None, budget: int = BUDGETS["task"]) -> str:
        """Skeletons of whole files in order while they fit; the first is always there."""
        symbols = self.table("entities").filter("kind = 'symbol'")
        units = surface.structural_units(symbols, files, deep or []).withColumn("text", F.concat("path", F.lit("\n"), "text"))
        place = F.array_position(F.array(*[F.lit(f) for f in files]), F.col("path"))
        kept = benchmark.units_within(units.select(F.lit(0).alias("g"), F.col("path").alias("id"), place.alias("position"), estimate_tokens(F.col("text")).alias("cost")), ["g"], budget)
        order = {r["path"]: r["text"] for r in units.collect()}  # as many rows as files were named
        ids = kept.first()
        return "\n".join(order[i] for i in ids["ids"]) if ids else ""

    # atlas and startup

    def compile_components(self, declared: DataFrame | None = None) -> DataFrame:
        """Components from packages, manifests, deployment units, commands and declared boundaries (name, dir, boundary); stored."""
        ents = self.table("entities")
        get = lambda k: F.get_json_object("attributes", f"$.{k}")
        units = lookups.unit_dirs(ents.filter("kind = 'deployment_unit'").select("name", get("build_context").alias("build_context"), get("image").alias("image"))).withColumn("boundary", F.lit("deployment"))
        packages = ents.filter("kind = 'package'").select("name", F.coalesce(get("path"), "name").alias("dir"), F.lit("package").alias("boundary"))
        commands = components.cli_dirs(ents).filter("dir <> ''").select(F.regexp_extract("dir", r"([^/]+)$", 1).alias("name"), "dir", F.lit("cli").alias("boundary"))
        tops = ents.filter("kind = 'symbol'").select(F.regexp_extract("path", r"^([^/]+)/", 1).alias("name")).filter("name <> ''").distinct().select("name", F.col("name").alias("dir"), F.lit("folder").alias("boundary"))
        rows = units.unionByName(packages).unionByName(commands).unionByName(tops)
        found = components.build_candidates(rows.unionByName(declared) if declared is not None else rows)
        self.state.replace("components", found.select(F.concat(F.lit("component:"), "name").alias("id"), "name", "dirs", "boundary", F.lit(None).cast("string").alias("attributes")))
        return self.state.read("components")

    def regions(self) -> DataFrame:
        return components.build_regions(self.table("files").select("path"), self.state.read("components"))

    def compile_flows(self, depth: int = graph.DEPTH) -> DataFrame:
        """Flows from routes, jobs and commands along trusted calls, and the graph of their steps; stored."""
        edges = self.trusted()
        entries = edges.filter("predicate = 'handles'").groupBy(F.col("subject").alias("id")).agg(F.min("object").alias("trigger"))
        calls = edges.filter("predicate = 'calls'").select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.lit(None).cast("string").alias("block"), "provenance", "evidence", provenance_rank(F.col("provenance")).alias("rank"))
        paths = cut(graph.bounded_paths(calls, entries.select("id"), depth))
        steps = flows.compile_flows(paths, calls)
        step = F.struct(F.col("order").cast("int").alias("order"), "actor", "operation", "provenance", "evidence")
        rows = steps.groupBy("flow").agg(F.sort_array(F.collect_list(step)).alias("steps")).join(entries, F.col("flow") == F.col("id"))
        self.state.replace("flows", rows.select(F.concat(F.lit("flow:"), "flow").alias("id"), F.col("flow").alias("entrypoint"), "trigger", "steps"))
        graphs = flows.flow_graph(paths, calls)["edges"]  # the edges of a node are bounded by the walks
        self.state.replace("flow_graphs", graphs.groupBy("from").agg(F.to_json(F.sort_array(F.collect_list(F.struct("to", "kind", "provenance")))).alias("graph")).select(F.col("from").alias("id"), "graph"))
        return self.state.read("flows")

    def recompile(self, declared: DataFrame | None = None) -> dict[str, int]:
        """The derived stages in order, each stored and read again by the next; returns their rows."""
        out = {"components": self.compile_components(declared).count(), "flows": self.compile_flows().count()}
        out["flow_graphs"] = self.state.read("flow_graphs").count()
        symbols = self.table("entities").filter("kind = 'symbol'").select(F.regexp_extract("path", r"^([^/]*)", 1).alias("component"), "name", F.get_json_object("attributes", "$.symbol_kind").alias("kind"), "signature")
        out["lifecycles"] = flows.lifecycles(symbols).count()
        self.state.add_findings(self.verify().select("kind", "severity", "message"))
        out["findings"] = self.state.read("drift").count()
        self.state.bump("model")
        return out

    def atlas(self, budget: int = BUDGETS["atlas"]) -> DataFrame:
        """(position, section, name, confidence, text): components, entry points, contracts, flows, landmarks and tests, the best known first, whole sections dropped from the end until the rest fits."""
        ents, edges, comps = self.table("entities"), self.trusted(), self.state.read("components")
        empty = F.array().cast("array<string>")
        of = lambda path: F.regexp_extract(F.coalesce(path, F.lit("")), r"^([^/]*)/", 1)
        symbols = ents.filter("kind = 'symbol'").groupBy(of(F.col("path")).alias("name")).agg(F.count("*").alias("symbols"))
        rows = comps.join(symbols, "name", "left").na.fill(0, ["symbols"])
        false = F.lit(False)
        has = dict.fromkeys(R.COMPONENT, false) | {"implementation": F.size("dirs") > 0, "symbols": F.col("symbols") > 0}
        section = lambda df, i, name, key, confidence, text: df.select(F.lit(i).alias("s"), F.lit(name).alias("section"), key.alias("name"), F.round(confidence, 6).alias("confidence"), text.alias("text"))
        out = section(rows, 0, "components", F.col("name"), R.component_confidence(has, F.lit("component")), F.concat("name", F.lit(": "), F.array_join("dirs", ", ")))
        entry = ents.filter("kind in ('route', 'job', 'command')")
        kind = F.when(F.col("kind") == "job", "queue").when(F.col("kind") == "command", "cli").otherwise("route")
        out = out.union(section(entry, 1, "entrypoints", F.col("name"), R.entrypoint_confidence(kind, F.col("id")), F.concat_ws(" ", "name", "path")))
        subclass = F.when(F.col("kind") == "configuration", "configuration").when(F.col("kind") == "topic", "event").when(F.col("kind") == "schema", "schema").otherwise("http")
        users = edges.groupBy(F.col("object").alias("id")).agg(F.sort_array(F.collect_set("subject")).alias("consumers"))
        contracts = ents.filter("kind in ('route', 'configuration', 'topic', 'schema')").join(users, "id", "left").withColumn("consumers", F.coalesce("consumers", empty))
        out = out.union(section(contracts, 2, "contracts", F.col("name"), R.contract_confidence(subclass, F.col("id"), F.lit(""), F.col("consumers"), F.col("consumers")), F.concat(F.col("name"), F.lit(" used by "), F.size("consumers").cast("string"))))
        out = out.union(section(self.state.read("flows"), 3, "flows", F.col("id"), F.lit(0.9), F.array_join(F.transform("steps", lambda s: s["operation"]), " -> ")))
        marks = surface.landmarks(ents.filter("kind = 'symbol'"), self.global_ranks())
        out = out.union(section(marks, 4, "landmarks", F.col("name"), F.col("rank"), F.concat_ws(" ", "name", "path")))
        out = out.union(section(ents.filter("kind = 'test'"), 5, "tests", F.col("name"), F.lit(0.5), F.concat_ws(" ", "name", "path")))
        out = cut(out.withColumn("tokens", estimate_tokens(F.col("text"))))
        sizes = out.groupBy(F.lit(0).alias("g"), F.col("section").alias("name"), (9 - F.col("s")).alias("priority"), (-F.col("s")).alias("position")).agg(F.sum("tokens").alias("cost"))
        kept = selection.drop_ladder(sizes, ["g"], budget).select(F.explode("kept").alias("section"))
        return out.join(kept, "section", "left_semi").orderBy("s", F.desc("confidence"), "name").select("section", "name", "confidence", "text", "tokens")

    def atlas_text(self, budget: int = BUDGETS["atlas"]) -> str:
        out, before = [], None
        for r in self.atlas(budget).collect():  # bounded by the budget
            if r["section"] != before:
                out.append(f"## {(before := r['section'])}")
            out.append(f"- {r['text']}")
        return "\n".join(out)

    def startup(self, budget: int = BUDGETS["startup"]) -> dict:
        """Atlas and surface for a new session, with the share of each and the hashes they rest on."""
        entities = self.table("entities").count()
        symbols = self.table("entities").filter("kind = 'symbol'").count()
        share = self.spark.range(1).select(S.adaptive_budget(F.lit(entities), F.lit(symbols))).first()[0]
        own = int(budget * share)
        rows = self.surface(50).withColumn("text", F.concat_ws(" ", "name", "path")).withColumn("cost", estimate_tokens(F.col("text")))
        kept = benchmark.units_within(rows.select(F.lit(0).alias("g"), "id", (-F.col("rank")).alias("position"), "cost"), ["g"], own).first()
        return {"atlas": self.atlas_text(budget - own), "surface": list(kept["ids"]) if kept else [], "epoch": self.state.epoch(), "generation": self.generation(), "budget": {"atlas": budget - own, "surface": own}}

    def warnings(self) -> DataFrame:
        """What a reader should know first: severe open findings, six at most by definition."""
        open_ = self.state.read("drift").filter("not resolved")
        return open_.filter(F.lower("severity").isin("high", "critical")).orderBy("message").limit(6).select("message")

    def check_invariants(self) -> DataFrame:
        """One row: whether no edge dangles, no writer conflicts and every invariant's scope is known."""
        bad = self.verify().filter("kind in ('dangling', 'conflicting_writers')").count()
        scopes = flows.resolve_scopes(self.state.read("invariants"), self.table("entities")).filter("id is null").count()
        return self.spark.createDataFrame([(bad, scopes, not bad and not scopes)], "findings long, unknown_scopes long, passed boolean")

    def verify(self) -> DataFrame:
        """Findings: dangling edges (external targets aside), resolved edges without evidence, conflicting writers."""
        edges, ents = self.table("edges"), self.table("entities")
        internal = edges.filter(~F.col("object").rlike("^(external|unknown):"))
        out = store.dangling(internal, ents).select(F.lit("dangling").alias("kind"), F.concat_ws(" ", "subject", "predicate", "object").alias("message"), F.lit("medium").alias("severity"))
        bare = edges.filter((F.col("provenance") == "RESOLVED") & (F.size("evidence") == 0))
        out = out.union(bare.select(F.lit("no_evidence"), "id", F.lit("high")))
        writers = derive.writer_groups(edges.filter("predicate = 'writes'"), "object", "subject")
        return out.union(writers.select(F.lit("conflicting_writers"), "object", F.lit("low")))

    def ci_check(self, allowed: str = "medium") -> DataFrame:
        return derive.ci_gate(self.verify(), allowed)

    # runtime

    def ingest_traces(self, payloads: DataFrame, body: str) -> DataFrame:
        """Edge sums of OTLP payloads and of plain edge lists."""
        otlp = payloads.filter(F.contains(body, F.lit("resourceSpans")))
        return traces.add_edges(traces.service_edges(traces.spans(otlp, body)), traces.simple_edges(payloads.filter(~F.contains(body, F.lit("resourceSpans"))), body))

    # exports

    def export_jsonl(self, path: str) -> None:
        """One typed record a line: entities, then edges, then evidence."""
        rows = None
        for i, name in enumerate(("entities", "edges", "evidence")):
            df = self.table(name)
            own = df.select(F.lit(i).alias("o"), F.col("id"), F.to_json(F.struct(F.lit(name).alias("type"), *df.columns)).alias("value"))
            rows = own if rows is None else rows.union(own)
        rows.repartitionByRange("o", "id").sortWithinPartitions("o", "id").select("value").write.text(path)

    def export_ir(self) -> DataFrame:
        """One typed JSON record a line: entities (each id once), edges, flows, invariants and evidence."""
        parts = {"entity": self.table("entities").dropDuplicates(["id"]), "relationship": self.table("edges"), "flow": self.state.read("flows"), "invariant": self.state.read("invariants"), "evidence": self.table("evidence")}
        out = None
        for name, df in parts.items():
            own = df.select(F.lit(name).alias("type"), F.col("id"), F.to_json(F.struct(*df.columns)).alias("record"))
            out = own if out is None else out.unionByName(own)
        return out

    def capsule(self) -> str:
        """A portable start in Markdown."""
        start = self.startup()
        return f"# Capsule {start['generation']}\n\n{start['atlas']}\n\n## surface\n" + "\n".join(f"- {i}" for i in start["surface"]) + "\n"

    def export(self, form: str, path: str) -> None:
        """Write one of system-ir, jsonl, layers, flow-graphs or capsule."""
        text = lambda s: self.spark.createDataFrame([(x,) for x in s.split("\n")], "value string").coalesce(1).write.text(path)
        writers = {
            "system-ir": lambda: self.export_ir().write.json(path), "jsonl": lambda: self.export_jsonl(path), "layers": lambda: self.export_layers().write.json(path),
            "flow-graphs": lambda: self.state.read("flow_graphs").write.json(path), "capsule": lambda: text(self.capsule()),
        }
        writers[form]()

    def checkpoint(self, id_: str) -> dict:
        """Save what changed in the last index and what it touches."""
        changed = sorted(r["path"] for r in self.table("change").filter("change <> 'same'").collect())  # one repository's changed files
        touched = self.impact(changed).groupBy("relation").count().collect()
        body = {"changed": changed, "touched": {r["relation"]: r["count"] for r in touched}, "generation": self.generation()}
        self.state.save_checkpoint(id_, body)
        return body

    def purge_all(self) -> None:
        """Empty the facts and the derived tables; settings, vectors and graphs of flows stay."""
        self._write({n: self.table(n).limit(0) for n in (*TABLES, "facts", "config", "change")}, f"g-empty-{self.spark._jvm.System.nanoTime()}")
        self.state.purge()

    def export_layers(self) -> DataFrame:
        """(layer, id, record): counts, architecture entities and symbols, a JSON record a row."""
        ents = self.table("entities")
        l0 = ents.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("L0").alias("layer"), F.col("kind").alias("id"), F.to_json(F.struct("kind", "n")).alias("record"))
        l1 = ents.filter("kind <> 'symbol'").select(F.lit("L1"), "id", F.to_json(F.struct("id", "kind", "name")))
        l2 = ents.filter("kind = 'symbol'").select(F.lit("L2"), "id", F.to_json(F.struct("id", "name", F.col("path").alias("file"))))
        return l0.union(l1).union(l2)
