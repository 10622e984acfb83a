"""Session transcripts: bounded turns, captures, pending counts, consolidation of reports into facts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.sources.scratch import written

from . import curation, models, similarity

#: A text's vector, and the confidence that two facts disagree.
Embedder = Callable[[Column], Column]
Judge = Callable[[Column, Column], Column]

FIRST_USER, LAST_ASSISTANT = 12, 40
#: Beginnings of user texts that a harness wrote (fixed values).
NOISE = ("<local-command", "<command-", "<bash-", "<system-reminder", "<user-prompt-submit-hook", "<post-tool-use")


def bounded_turns(turns: DataFrame, key: str = "session") -> DataFrame:
    """turns (key, turn, role, text) -> the first 12 user turns and the last 40 assistant turns, in text form."""
    text = X.stripped(F.col("text"))
    noise = F.lit(False)
    for prefix in NOISE:
        noise = noise | F.lower(text).startswith(prefix)
    real = turns.where(F.col("role").isin("user", "assistant")).withColumn("text", text).where("text <> ''").where(~((F.col("role") == "user") & noise))
    forward = F.row_number().over(Window.partitionBy(key, "role").orderBy("turn"))
    backward = F.row_number().over(Window.partitionBy(key, "role").orderBy(F.desc("turn")))
    users = real.where("role = 'user'").withColumn("n", forward).where(F.col("n") <= FIRST_USER)
    assistants = real.where("role = 'assistant'").withColumn("n", backward).where(F.col("n") <= LAST_ASSISTANT)
    return users.unionByName(assistants).select(key, "turn", "role", "text")


def transcript_turns(lines: DataFrame) -> DataFrame:
    """read_transcripts() rows as turns in the order of the file, side chains left out."""
    said = lines.where(~F.col("sidechain") & F.col("type").isin("user", "assistant"))
    cut = said.select(F.col("file").alias("session"), "line", F.col("type").alias("role"), F.posexplode("texts").alias("k", "text"))
    return cut.select("session", F.struct("line", "k").alias("turn"), "role", "text")


def metadata(lines: DataFrame, key: str = "file") -> DataFrame:
    """read_transcripts() rows -> (key, session_id, cwd, branch, captured), one row per file.

    The first value that is not empty counts, of lines outside side chains. captured: whether any
    line, side chains included, calls a capture tool.
    """
    first = lambda name: F.coalesce(F.min(F.when(~F.col("sidechain") & (F.coalesce(F.col(name), F.lit("")) != ""), F.struct("line", name)))[name], F.lit(""))
    return lines.groupBy(key).agg(first("session").alias("session_id"), first("cwd").alias("cwd"), first("branch").alias("branch"), F.coalesce(F.bool_or("captured"), F.lit(False)).alias("captured"))


def _bullets(heading: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"## {heading}\n- "), F.array_join(items, "\n- ")))


def capture(turns: DataFrame, key: str = "session") -> DataFrame:
    """turns -> (key, title, task, outcome, decisions, actions, files, content), one row per session with a turn, scrubbed.

    content is the report in sections; decisions and actions are read from assistant turns only.
    """
    gathered = bounded_turns(turns, key).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"]).alias("users"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"]).alias("assistants"),
    )
    assistant = F.array_join("assistants", "\n")
    everything = F.concat(assistant, F.lit("\n"), F.array_join("users", "\n"))
    title = F.substring(X.stripped(F.get(F.split(F.get("users", F.lit(0)), X.LINE, 2), F.lit(0))), 1, 80)
    found = gathered.select(
        key,
        F.when(F.coalesce(title, F.lit("")) == "", "session").otherwise(title).alias("title"),
        F.substring(F.get("users", F.lit(0)), 1, 600).alias("task"),
        F.substring(F.get("assistants", F.size("assistants") - 1), 1, 600).alias("outcome"),
        X.first_matches(assistant, X.DECISION, 8).alias("decisions"),
        X.first_matches(assistant, X.ACTION, 10).alias("actions"),
        X.first_matches(everything, X.FILE_PATH, 20).alias("files"),
    )
    summary = F.concat_ws("\n\n", F.concat(F.lit("Task: "), "task"), F.concat(F.lit("Outcome: "), "outcome"))
    sections = (F.concat(F.lit("## Summary\n"), summary), _bullets("Decisions", F.col("decisions")), _bullets("Action items (ACT-NOW)", F.col("actions")), _bullets("Files touched", F.col("files")))
    clean = X.stripped(X.scrubbed(F.col("title")))
    lists = [F.transform(c, X.scrubbed).alias(c) for c in ("decisions", "actions", "files")]
    return found.select(key, F.when(clean == "", "session").otherwise(clean).alias("title"), X.scrubbed(F.col("task")).alias("task"), X.scrubbed(F.col("outcome")).alias("outcome"), *lists, X.scrubbed(F.concat_ws("\n\n", *sections)).alias("content"))


def _lane(cwd: Column, project: Column, repos: str, base: str) -> tuple[Column, Column]:
    """The folder that a session's notes go to, and its project: the named one, the repository of cwd, or the shared lane."""
    path = X.slashes(cwd)
    inside = F.when(path.startswith(f"{repos}/"), F.get(F.split(F.substring(path, len(repos) + 2, 1 << 20), "/"), F.lit(0)))
    repository = F.coalesce(F.nullif(project, F.lit("")), F.nullif(inside, F.lit("")))
    return F.when(repository.isNotNull(), F.concat(F.lit(f"{repos}/"), repository, F.lit("/research/sessions"))).otherwise(f"{base}/library/sessions"), F.coalesce(repository, F.lit("adhoc"))


def _root(name: Column) -> Column:
    """A name without the numbers at its end: what names that can get into each other's way have in common."""
    return F.regexp_replace(name, "(-[0-9]+)+$", "")


def _one_by_one(notes: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """The first free number for each note in turn, where stems may be numbered forms of each other."""
    taken, numbers, following = set(held["name"]), [], {}
    notes = notes.sort_values("seq", kind="stable")
    for stem in notes["stem"]:
        n = following.get(stem, 1)
        while (name := stem if n == 1 else f"{stem}-{n}") in taken:
            n += 1
        taken.add(name)
        following[stem] = n + 1
        numbers.append(n)
    return notes.assign(number=numbers)


def _numbered(notes: DataFrame, held: DataFrame | None) -> DataFrame:
    """notes (…, seq, stem, lane) with path: lane/stem.md, or stem-2, stem-3 …, the first name that neither held (path) nor an earlier note has.

    Where all notes of a lane that could meet have one stem, the n-th takes the n-th number that is not held, which the held
    numbers alone say. Only stems that are numbered forms of each other are gone through one after the other, by their names alone.
    """
    thin = notes.select("lane", "stem", "seq", _root(F.col("stem")).alias("root"))
    split = F.regexp_extract("path", r"^(.*)/([^/]*)\.md$", 1), F.regexp_extract("path", r"^(.*)/([^/]*)\.md$", 2)
    if held is None:
        held = thin.limit(0).select(F.concat_ws("/", "lane", F.concat("stem", F.lit(".md"))).alias("path"))
    names = held.select(split[0].alias("lane"), split[1].alias("name")).where("name <> ''").distinct().withColumn("root", _root(F.col("name")))
    families = thin.groupBy("lane", "root").agg((F.min("stem") != F.max("stem")).alias("several"))
    marked = thin.join(families, ["lane", "root"])
    # one stem: the held numbers of a stem, each less the held ones before it; those up to n push the n-th note on
    at = F.expr("case when name = stem then 1 else cast(regexp_extract(name, '^.*-([1-9][0-9]*)$', 1) as int) end")
    stems = marked.where("not several").select("lane", "root", "stem").distinct()
    own = stems.join(names, ["lane", "root"]).where("name = stem or (startswith(name, stem || '-') and substring(name, length(stem) + 2) rlike '^([2-9]|[1-9][0-9]+)$')").select("lane", "stem", at.alias("at"))
    before = own.withColumn("push", F.col("at") - F.row_number().over(Window.partitionBy("lane", "stem").orderBy("at")) + 1).groupBy("lane", "stem").agg(F.array_sort(F.collect_list("push")).alias("pushes"))
    turn = F.row_number().over(Window.partitionBy("lane", "stem").orderBy("seq"))
    plain = marked.where("not several").withColumn("n", turn).join(before, ["lane", "stem"], "left")
    pushed = F.coalesce(F.size(F.filter("pushes", lambda x: x <= F.col("n"))), F.lit(0))
    plain = plain.select("lane", "stem", "seq", (F.col("n") + F.when(F.col("pushes").isNull(), 0).otherwise(pushed)).cast("int").alias("number"))
    key = ["lane", "root"]
    mixed = marked.where("several").select("lane", "root", "stem", "seq").groupBy(*key).cogroup(names.groupBy(*key))
    kind = thin.schema["seq"].dataType.simpleString()
    schema = f"lane string, root string, stem string, seq {kind}, number int"
    turns = mixed.applyInPandas(lambda some, taken: _one_by_one(some, taken) if len(some) else some.assign(number=[]), schema).select("lane", "stem", "seq", "number")
    numbers = plain.unionByName(turns)
    named = notes.join(numbers, ["lane", "stem", "seq"])
    suffix = F.when(F.col("number") > 1, F.concat(F.lit("-"), F.col("number").cast("string"))).otherwise("")
    return named.withColumn("path", F.concat("lane", F.lit("/"), "stem", suffix, F.lit(".md"))).drop("number")


def capture_sessions(lines: DataFrame, held: DataFrame | None, now: str, repos: str = "repos", base: str = "vault") -> DataFrame:
    """read_transcripts() rows -> (file, path, text), the note that each session's end writes.

    Left out: sessions that called a capture tool, those whose id (its first eight characters) is in
    the name of a file of their lane in held (path), and those without a turn. now: 'yyyy-MM-dd HH:mm:ss'.
    """
    about = metadata(lines).where(~F.col("captured")).withColumn("short", F.substring("session_id", 1, 8))
    lane, project = _lane(F.col("cwd"), F.lit(""), repos, base)
    placed = about.withColumns({"lane": lane, "project": project})
    if held is not None:
        names = held.select(F.regexp_extract("path", r"^(.*)/[^/]*\.md$", 1).alias("held_lane"), F.regexp_extract("path", r"/([^/]*)\.md$", 1).alias("held_name"))
        # an id is one of the parts of a name that eight characters long; ids without a hyphen are whole parts
        parts = names.select("held_lane", F.explode(F.sequence(F.lit(1), F.greatest(F.length("held_name") - 7, F.lit(1)))).alias("at"), "held_name").select("held_lane", F.expr("substring(held_name, at, 8)").alias("held_short")).distinct()
        placed = placed.join(parts, (F.col("lane") == F.col("held_lane")) & (F.col("short") == F.col("held_short")) & (F.length("short") == 8), "left_anti")
    date, time = now[:10], now[11:].replace(":", "")
    said = capture(transcript_turns(lines)).where("content <> ''").withColumnRenamed("session", "file")
    sid = F.when(F.col("short") == "", "adhoc").otherwise(F.col("short"))
    notes = placed.join(said, "file").withColumn("sid", sid).withColumn("stem", F.concat(F.lit(f"{date}-{time}-"), "sid")).withColumn("seq", F.col("file"))
    head = X.frontmatter(F.lit("session"), project=F.col("project"), session_id=F.col("sid"), date=F.lit(date), time=F.lit(time), cwd=X.slashes(F.col("cwd")), git_branch=F.col("branch"), captured_by=F.lit("sessionend-hook"))
    text = F.concat(head, F.lit(f"# Session {date} — "), "title", F.lit("\n\n"), X.stripped(F.col("content")), F.lit("\n"))
    return _numbered(notes, held).select("file", "path", text.alias("text"))


def capture_memories(notes: DataFrame, held: DataFrame | None, now: str, repos: str = "repos", base: str = "vault") -> DataFrame:
    """notes (seq, content, title, project, kind, session_id, cwd) -> (seq, status, path, text), the file that each call writes.

    A project of an unsafe name is an error. Content and title are scrubbed; a file is never
    overwritten: a name that is taken gets a number.
    """
    date, time = now[:10], now[11:].replace(":", "")
    blank = lambda name: F.coalesce(F.col(name), F.lit(""))
    lane, label = _lane(blank("cwd"), blank("project"), repos, base)
    content, title = X.scrubbed(blank("content")), X.stripped(X.scrubbed(blank("title")))
    sid = F.substring(F.regexp_replace(blank("session_id"), "[^A-Za-z0-9-]", ""), 1, 8)
    made = notes.withColumns({"lane": lane, "label": label, "safe_content": content, "safe_title": F.when(title == "", "untitled").otherwise(title), "sid": F.when(sid == "", "adhoc").otherwise(sid), "wrong": (blank("project") != "") & ~X.safe_name(blank("project"))})
    slug = X.slug(F.col("safe_title"))
    made = made.withColumn("stem", F.concat(F.lit(f"{date}-{time}-"), "sid", F.lit("-"), F.when(slug == "", F.substring(X.content_hash(F.col("safe_content")), 1, 6)).otherwise(slug)))
    head = X.frontmatter(blank("kind"), project=F.col("label"), session_id=F.col("sid"), date=F.lit(date), time=F.lit(time), cwd=X.slashes(blank("cwd")), git_branch=F.lit(""), captured_by=F.lit("capture_memory"))
    first = F.concat(F.when(blank("kind") == "session", F.lit(f"# Session {date} — ")).otherwise("# "), F.col("safe_title"))
    text = F.concat(head, first, F.lit("\n\n"), X.stripped(F.col("safe_content")), F.lit("\n"))
    written = _numbered(made.where("not wrong"), held).select("seq", F.lit("written").alias("status"), "path", text.alias("text"))
    nothing = F.lit(None).cast("string")
    return written.unionByName(made.where("wrong").select("seq", F.lit("error").alias("status"), nothing.alias("path"), nothing.alias("text")))


def recent_sessions(files: DataFrame, project: str | None, days: int, now: str, repos: str = "repos", base: str = "vault") -> DataFrame:
    """files (path, modified, …) of one project's session lane, or of all lanes, not older than `days`; none or fewer days: all."""
    path = X.slashes(F.col("path"))
    if project:
        lane = path.rlike(rf"(^|/)\Q{repos}/{project}/research/sessions/\E[^/]*\.md$")
    else:
        lane = path.rlike(rf"(^|/)\Q{repos}\E/[^/]+/research/sessions/[^/]*\.md$") | path.rlike(rf"(^|/)\Q{base}/library/sessions/\E[^/]*\.md$")
    kept = files.where(lane)
    days = min(int(days), 36500)
    return kept if days <= 0 else kept.where(F.col("modified").cast("timestamp") >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))


def pending(rows: DataFrame, base: str = "vault") -> DataFrame:
    """Session documents per project."""
    return rows.where("source_type = 'session'").groupBy(X.session_project(F.col("doc_path"), base).alias("project")).agg(F.count("*").alias("pending"))


def facts(rows: DataFrame, cap: int = 120) -> DataFrame:
    """rows (id, text) -> (id, n, fact)."""
    return rows.select("id", F.posexplode(X.fact_units(F.coalesce("text", F.lit("")), cap)).alias("n", "fact"))


def contradictions(old: DataFrame, new: DataFrame, gate: float = 0.4, least: float = 0.7, group: str | None = None, embedder: Embedder = models.embed, nli: Judge = models.contradiction) -> DataFrame:
    """old, new (id, fact) with distinct ids -> (prior, newer, confidence): each new fact against its nearest old one.

    With a group column on both sides, only facts of one group are compared, and it is carried along.
    """
    within = [group] if group else []
    left = new.select(*within, F.col("id").alias("query_id"), F.col("fact").alias("newer"))
    right = old.select(*within, "id", F.col("fact").alias("prior"))
    vector = embedder(F.col("fact")).alias("vector")
    held, asked = written(old.select(*within, "id", vector), "held"), written(new.select(*within, F.col("id").alias("query_id"), vector), "asked")
    near = similarity.nearest(held, asked, gate, group)
    paired = near.select("query_id", "id").join(right, "id").join(left.drop(*within), "query_id")
    scored = paired.withColumn("confidence", F.round(nli(F.col("prior"), F.col("newer")), 3))
    return scored.where(F.col("confidence") >= least).select(*within, "prior", "newer", "confidence")


def consolidated(reports: DataFrame, group: str = "project", budget: int = curation.BUDGET) -> DataFrame:
    """reports (project, doc_path, text) -> one curated row per project: all fact lines of the reports within the budget, scrubbed.

    pending reports are left for the next run. Only lengths pass through the ordered window; texts are joined to
    what it lets in.
    """
    packed = curation.within_budget(reports.select(group, "doc_path", F.length("text").alias("length")), group, ["doc_path"], budget)
    let_in = packed.where("status <> 'pending'").select(group, "doc_path", "used")
    taken = reports.join(let_in, [group, "doc_path"]).select(group, "doc_path", F.substring(F.col("text"), F.lit(1), F.col("used")).alias("text"))
    body = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_path", "text"))), lambda r: X.fact_lines(r["text"]))), "\n")
    counted = packed.groupBy(group).agg(F.count_if(F.col("status") != "pending").alias("n_sources"), F.count_if(F.col("status") == "pending").alias("n_pending"), F.count_if(F.col("status") == "clamped").alias("n_clamped"), F.sum("used").alias("used"))
    return taken.groupBy(group).agg(X.scrubbed(body).alias("body")).join(counted, group)


def consolidate(reports: DataFrame, notes: DataFrame, today: str, group: str = "project", budget: int = curation.BUDGET, gate: float = 0.4, least: float = 0.7, embedder: Embedder = models.embed, nli: Judge = models.contradiction) -> DataFrame:
    """reports (project, doc_path, text), notes (project, text) -> (project, status, note, n_sources, n_pending, n_clamped, n_contradictions, nli, bloated).

    The canonical body of an existing note is kept but for facts that a newer report contradicts, the new
    facts follow, then the contradictions, all scrubbed, a title and the sources. status: empty_consolidation
    where no fact is left, else consolidated; nli: ran, or no_prior_note. Reports past the budget are pending.
    """
    fresh = written(consolidated(reports, group, budget), "fresh")
    prior = notes.groupBy(group).agg(X.canonical_body(F.max("text")).alias("existing"))
    unit = lambda rows, name: rows.select(group, F.posexplode(X.fact_units(F.col(name))).alias("n", "fact")).select(group, F.xxhash64(group, F.lit(name), "n", "fact").alias("id"), "fact")
    old, new = unit(prior, "existing"), unit(fresh, "body")
    flagged = contradictions(old, new, gate, least, group, embedder, nli)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("newer", "prior", "confidence"))), lambda c: F.concat(F.lit("- **prior:** "), c["prior"], F.lit("\n  **newer:** "), c["newer"], F.lit("  _(NLI "), c["confidence"].cast("string"), F.lit(")_")))
    found = flagged.groupBy(group).agg(F.array_join(lines, "\n").alias("flagged"), F.count("*").alias("n_contradictions"), F.collect_set("prior").alias("superseded"))
    files = reports.join(curation.within_budget(reports.select(group, "doc_path", F.length("text").alias("length")), group, ["doc_path"], budget).where("status <> 'pending'").select(group, "doc_path"), [group, "doc_path"])
    sources = files.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.element_at(F.split("doc_path", "/"), -1)))), "\n").alias("sources"))
    joined = fresh.join(prior, group, "left").join(found, group, "left").join(sources, group)
    existing = F.coalesce("existing", F.lit(""))
    kept = F.array_join(F.filter(F.split(existing, "\n"), lambda line: ~F.exists(F.coalesce("superseded", F.array().cast("array<string>")), lambda p: F.contains(line, p))), "\n")
    merged = F.concat_ws("\n", F.nullif(kept, F.lit("")), F.nullif(F.col("body"), F.lit("")))
    merged = X.scrubbed(F.concat_ws("\n\n", F.nullif(merged, F.lit("")), F.when(F.col("flagged").isNotNull() & (merged != ""), F.concat(F.lit(f"{X.CONTRADICTIONS}\n"), "flagged"))))
    note = F.concat(F.lit("# "), F.col(group), F.lit(f"\n\n_Consolidated {today} from "), F.col("n_sources").cast("string"), F.lit(" session capture(s)._\n\n"), X.stripped(F.col("merged")), F.lit("\n\n## Sources\n"), F.col("sources"), F.lit("\n"))
    out = joined.withColumn("merged", merged)
    empty = X.stripped(F.col("merged")) == ""
    return out.select(
        group,
        F.when(empty, "empty_consolidation").otherwise("consolidated").alias("status"),
        F.when(~empty, note).alias("note"),
        "n_sources",
        "n_pending",
        "n_clamped",
        F.coalesce("n_contradictions", F.lit(0)).alias("n_contradictions"),
        F.when(existing == "", "no_prior_note").otherwise("ran").alias("nli"),
        ((existing != "") & curation.bloated(F.length("merged"), F.length(existing), F.col("used"))).alias("bloated"),
    )
