"""Extracted knowledge: sources, topics, artifact checks, JSON repair."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions import text as X
from tidemark.sources.folders import checkpointed

#: The keys that an artifact of each kind needs.
REQUIRED = {"quiz": ["quiz"], "flashcards": ["flashcards"], "mindmap": ["content"], "formula_sheet": ["formulas", "topic_groups"], "interview": ["technical_questions", "conceptual_questions"], "revision": ["quick_facts", "must_know_points"], "detailed_notes": ["notes_markdown"]}


def required(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in REQUIRED.items()], "kind string, required array<string>")


#: Topics of a lecture in a block, of which a task compares two; and topics in one matrix product.
BLOCK, STEP = 4096, 512


def topic_pairs(topics: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs i < j of a lecture's topics that are more alike than threshold, by cosine in double precision; a vector without length is like none.

    A lecture's topics are dealt out to blocks by their number, and each task compares two
    blocks, so a large lecture is spread over many tasks of one size.
    """
    n = topics.groupBy("video_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = topics.select("video_id", "topic_id", "vector").join(n, "video_id").withColumn("own", F.pmod(F.xxhash64("topic_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = dealt.withColumn("other", other).select("video_id", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "topic_id", "vector")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        video, a, b = key
        v = np.array([np.asarray(x, np.float64) for x in pdf["vector"]])
        norm = np.sqrt((v * v).sum(axis=1))
        v /= np.where(norm > 0, norm, 1)[:, None]
        ids, own = pdf["topic_id"].to_numpy(), pdf["own"].to_numpy()
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        out = []
        for k in range(0, len(left), STEP):
            s = v[left[k : k + STEP]] @ v[right].T
            x, y = np.nonzero(s > threshold)
            i, j, s = ids[left[k + x]], ids[right[y]], s[x, y]
            keep = (i < j) if a == b else np.ones(len(i), bool)
            out.append(pd.DataFrame({"video_id": video, "i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "similarity": np.round(s[keep], 6)}))
        return pd.concat(out) if out else pd.DataFrame({"video_id": [], "i": [], "j": [], "similarity": []})

    return rows.groupBy("video_id", "a", "b").applyInPandas(run, "video_id long, i long, j long, similarity double")


#: Links that are left, from which on one bounded task settles them.
FINISH = 100_000


def absorb(topics: DataFrame, pairs: DataFrame, finish: int = FINISH) -> DataFrame:
    """(video_id, topic_id, into): the lowest topic that isn't taken takes every later one that is like it and isn't taken; this isn't transitive.

    In rounds over all lectures at once: topics without a lower one left that is like them take theirs; links of what is
    taken go. A round settles every topic whose lower ones are settled, so there are few unless likeness forms long chains; the
    last links, finish of them at most, are settled in one task. A taken topic goes to the lowest taker that is like it.
    """
    store = checkpointed(topics.sparkSession)
    links = pairs.select("video_id", "i", "j").where("i < j").distinct()
    all_links = left = store(links)
    gone = topics.sparkSession.createDataFrame([], left.select("video_id", "j").schema)
    while (n := left.count()) > finish:
        takers = left.select("video_id", "i").distinct().join(left.select("video_id", F.col("j").alias("i")).distinct(), ["video_id", "i"], "left_anti")
        taken = store(left.join(takers, ["video_id", "i"], "left_semi").select("video_id", "j").distinct())
        gone = gone.unionByName(taken)
        rest = left.join(taken, ["video_id", "j"], "left_anti")
        left = store(rest.join(taken.withColumnRenamed("j", "i"), ["video_id", "i"], "left_anti"))
    if n:
        gone = gone.unionByName(left.coalesce(1).mapInPandas(_settled, gone.schema))
    gone = store(gone)
    free = all_links.join(gone.withColumnRenamed("j", "i"), ["video_id", "i"], "left_anti")
    into = free.join(gone, ["video_id", "j"], "left_semi").groupBy("video_id", F.col("j").alias("topic_id")).agg(F.min("i").alias("taker"))
    return topics.select("video_id", "topic_id").join(into, ["video_id", "topic_id"], "left").select("video_id", "topic_id", F.coalesce("taker", "topic_id").alias("into"))


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Topics that are taken by the links of batches."""
    links = pd.concat(list(batches)).sort_values(["video_id", "i", "j"])
    taken: set[tuple] = set()
    for video, i, j in links.itertuples(index=False):
        if (video, i) not in taken:
            taken.add((video, j))
    yield pd.DataFrame(sorted(taken), columns=["video_id", "j"])


def merge_topics(topics: DataFrame, into: DataFrame) -> DataFrame:
    """Topics with what they took in: takeaways without repeats in order, citations (timestamp, text) of which the first of a timestamp stays, and the
    latest end_time, by text. What repeats is dropped before it is gathered, so a topic that took many in stays as small as what it says."""
    rows = topics.join(into, ["video_id", "topic_id"])

    def listed(column: str, key: str | None) -> DataFrame:
        each = rows.select("video_id", "into", "topic_id", F.posexplode(column).alias("pos", "x"))
        by = F.col("x") if key is None else F.col("x")[key]
        first = each.groupBy("video_id", "into", by.alias("by")).agg(F.min(F.struct("topic_id", "pos", "x")).alias("first"))
        return first.groupBy("video_id", "into").agg(F.transform(F.array_sort(F.collect_list("first")), lambda f: f["x"]).alias(column))

    heads = rows.groupBy("video_id", "into").agg(F.max("end_time").alias("end_time"), F.count("*").alias("merged"))
    for column, key in (("takeaways", None), ("citations", "timestamp")):
        heads = heads.join(listed(column, key), ["video_id", "into"], "left").withColumn(column, F.coalesce(column, F.array().cast(topics.schema[column].dataType)))
    return heads.withColumnRenamed("into", "topic_id")


def missing_keys(artifacts: DataFrame, spark: SparkSession) -> DataFrame:
    """Whether each artifact has the keys its kind needs."""
    have = F.coalesce(F.json_object_keys("content"), F.array().cast("array<string>"))
    rows = artifacts.join(F.broadcast(required(spark)), "kind", "left")  # a constant list
    return rows.withColumn("missing", F.array_except(F.coalesce("required", F.array().cast("array<string>")), have)).withColumn("valid", (F.size("missing") == 0) & F.json_object_keys("content").isNotNull()).drop("required")


def hallucination_risk(notes: DataFrame, transcripts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Share of a text's proper nouns that neither the transcript (as a part) nor a concept's name has."""
    terms = notes.select("video_id", F.explode(X.proper_nouns(F.col("text"))).alias("term"))
    checked = terms.join(transcripts.select("video_id", F.lower("full_text").alias("said")), "video_id", "left").withColumn("unsaid", ~F.coalesce(F.contains(F.col("said"), F.col("term")), F.lit(False))).select("video_id", "term", "unsaid")
    novel = checked.where("unsaid").join(concepts.select("video_id", F.lower("name").alias("term")).distinct(), ["video_id", "term"], "left_anti").groupBy("video_id").agg(F.count("*").alias("novel"))
    n = terms.groupBy("video_id").agg(F.count("*").alias("terms"))
    out = notes.select("video_id").join(n, "video_id", "left").join(novel, "video_id", "left")
    return out.select("video_id", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("novel", F.lit(0)).alias("novel"), F.coalesce(F.round(F.col("novel") / F.col("terms"), 4), F.lit(0.0)).alias("risk"))


def artifact_quality(checked: DataFrame, risks: DataFrame) -> DataFrame:
    score = F.greatest(F.lit(0.0), F.when(F.col("valid"), 1.0).otherwise(0.5) - F.col("risk") * 0.5)
    warnings = F.filter(F.array(F.when(~F.col("valid"), F.lit("SCHEMA_INVALID")), F.when(F.col("risk") > 0.3, F.lit("HALLUCINATION_RISK"))), lambda w: w.isNotNull())
    return checked.join(risks, "video_id").select("video_id", "kind", "valid", "risk", F.round(score, 4).alias("score"), F.size(warnings).alias("n_warnings"))


def resolve_sources(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items with the times of the chunks they cite; an unknown chunk keeps the times given, and an item without sources gets its own chunk's."""
    own = F.when(F.size("sources") == 0, F.array(F.struct(F.col("chunk_id"), F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s")))).otherwise(F.col("sources"))
    refs = items.select("item", F.posexplode(own).alias("pos", "s")).select("item", "pos", "s.*")
    known = chunks.select("chunk_id", F.col("start_s").alias("a"), F.col("end_s").alias("b"))
    return refs.join(known, "chunk_id", "left").select("item", "pos", "chunk_id", F.coalesce("a", "start_s").alias("start_s"), F.coalesce("b", "end_s").alias("end_s"))


def first_wins(maps: DataFrame) -> DataFrame:
    """Maps of a lecture's chunks merged: the first chunk that has a key gives its value."""
    rows = maps.select("video_id", "chunk", F.explode("notation").alias("key", "value"))
    best = rows.groupBy("video_id", "key").agg(F.min_by("value", "chunk").alias("value"))
    return best.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("notation"))


def append_groups(maps: DataFrame, names: DataFrame) -> DataFrame:
    """Lists of a lecture's chunks by topic: only known names, each once, empty ones left out."""
    rows = maps.select("video_id", F.explode("groups").alias("topic", "members")).select("video_id", "topic", F.explode("members").alias("name"))
    return rows.join(names, ["video_id", "name"], "left_semi").groupBy("video_id", "topic").agg(F.array_sort(F.collect_set("name")).alias("names"))


def context_packet(windows: DataFrame, segments: DataFrame, frames: DataFrame) -> DataFrame:
    """For each topic window: the segments that start in it, in order, and how many frames lie in it."""
    w = windows.where("end_s > start_s").select("video_id", "topic_id", F.col("start_s").alias("a"), F.col("end_s").alias("b"))
    said = segments.join(w, "video_id").where("start_s between a and b").groupBy("video_id", "topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("packet"), F.count("*").alias("n_segments"))
    seen = frames.join(w, "video_id").where((F.col("timestamp_ms") / 1000).between(F.col("a"), F.col("b"))).groupBy("video_id", "topic_id").agg(F.count("*").alias("n_frames"))
    return w.select("video_id", "topic_id").join(said, ["video_id", "topic_id"], "left").join(seen, ["video_id", "topic_id"], "left").na.fill(0, ["n_segments", "n_frames"])


def repair_json(content: str | None) -> tuple[str | None, str | None]:
    """The outermost object of a model's text as JSON, or an error. Commas before a closing bracket outside strings are dropped."""
    begin, end = (content or "").find("{"), (content or "").rfind("}")
    if begin < 0 or end < begin:
        return None, "NO_OBJECT"
    body = content[begin : end + 1]
    for attempt in (body, _without_trailing_commas(body)):
        try:
            value = json.loads(attempt)
        except ValueError:
            continue
        return (json.dumps(value, ensure_ascii=False, sort_keys=True), None) if isinstance(value, dict) else (None, "NOT_AN_OBJECT")
    return None, "UNREPAIRABLE"


def _without_trailing_commas(body: str) -> str:
    out, quoted, escaped = [], False, False
    for c in body:
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "}]":
            while out and (out[-1].isspace()):
                out.pop()
            if out and out[-1] == ",":
                out.pop()
        out.append(c)
    return "".join(out)


@F.pandas_udf(StringType())
def repaired(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield pd.Series([repair_json(x)[0] for x in t], dtype=object)


def parsed(responses: DataFrame) -> DataFrame:
    """Responses with their object: Spark parses what is well-formed, only the rest is repaired in Python."""
    good = F.when(F.try_parse_json("content").isNotNull() & F.trim("content").startswith("{"), F.col("content"))
    whole = responses.withColumn("direct", good)
    clean = whole.where("direct is not null").withColumn("object", F.col("direct"))
    rest = whole.where("direct is null").withColumn("object", repaired(F.col("content")))
    return clean.unionByName(rest).withColumn("ok", F.col("object").isNotNull()).drop("direct")


def usage_of(responses: DataFrame) -> DataFrame:
    """Token usage of captured responses, 0 where absent, and whether the answer was cut."""
    u = F.from_json("usage", "prompt_tokens long, completion_tokens long, total_tokens long")
    n = lambda c: F.coalesce(u[c], F.lit(0)).alias(c)
    return responses.select("request_id", n("prompt_tokens"), n("completion_tokens"), n("total_tokens"), F.coalesce(F.col("finish_reason") == "length", F.lit(False)).alias("truncated"))


def violations(answers: DataFrame) -> DataFrame:
    """A row for each value outside its bounds."""
    rule = lambda bad, name: F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    found = F.array(rule(~F.col("difficulty").between(1, 5), "difficulty"), rule(~F.col("confidence").between(0.0, 1.0), "confidence"), rule(F.col("study_minutes") < 0, "study_minutes"), rule(F.length("summary") < 20, "summary"), rule(F.length("title") < 1, "title"), rule(~F.col("at").rlike(r"^\d{2}:\d{2}:\d{2}$"), "at"))
    return answers.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("field"))


#: Headings of a topic note, in order, and how an entry is written; %s is the entry.
NOTE_LISTS = [("steps", "### How It Works (Steps)", "%d. %s"), ("relationships", "### Relationships With Other Concepts", "- %s"), ("misconceptions", "### Common Misconceptions", "- %s"), ("key_takeaways", "### Key Takeaways / Exam Perspective", "- %s")]
NOTE_TEXTS = [("overview", "### Overview"), ("core_idea", "### Core Idea")]
NOTE_FORMULAS, NOTE_EXAMPLES = "### Mathematical Formulation", "### Examples"
NOTE_TERMS = "### Important Terms\n| Term | Meaning |\n|---|---|"


def topic_note(topics: DataFrame) -> Column:
    """A topic's note in Markdown; sections whose column is missing, null or empty are left out. A ready notes_markdown stands for the whole.

    important_terms are (term, meaning), formulas (expression, explanation), examples either a text or (problem, solution).
    """
    have = set(topics.columns)
    pieces = [F.concat(F.lit("## "), F.coalesce("title", F.lit("Untitled Topic")), F.lit("\n\n"))]

    def section(heading: str, body: Column, filled: Column) -> None:
        pieces.append(F.when(filled, F.concat(F.lit(heading + "\n"), body, F.lit("\n\n"))))

    for name, heading in NOTE_TEXTS:
        if name in have:
            section(heading, F.col(name), F.col(name) != "")
    for name, heading, form in NOTE_LISTS:
        if name == "relationships" and "important_terms" in have:  # terms, formulas and examples stand behind the steps
            rows = F.transform("important_terms", lambda x: F.concat(F.lit("| **"), F.coalesce(x["term"], F.lit("")), F.lit("** | "), F.coalesce(x["meaning"], F.lit("")), F.lit(" |")))
            section(NOTE_TERMS, F.array_join(rows, "\n"), F.size("important_terms") > 0)
        if name == "relationships" and "formulas" in have:
            explained = lambda x: F.when(F.coalesce(x["explanation"], F.lit("")) != "", F.concat(F.lit("\n> "), x["explanation"])).otherwise("")
            rows = F.transform("formulas", lambda x: F.concat(F.lit("**"), F.coalesce(x["expression"], F.lit("")), F.lit("**"), explained(x), F.lit("\n")))
            section(NOTE_FORMULAS, F.array_join(rows, "\n"), F.size("formulas") > 0)
        if name == "relationships" and "examples" in have:
            solved = lambda x: F.concat(F.lit("**Scenario:** "), F.coalesce(x["problem"], F.lit("")), F.lit("\n**Solution:** "), F.coalesce(x["solution"], F.lit("")), F.lit("\n"))
            section(NOTE_EXAMPLES, F.array_join(F.transform("examples", lambda x: F.coalesce(F.concat(F.lit("- "), x["text"]), solved(x))), "\n"), F.size("examples") > 0)
        if name in have:
            entry = (lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)) if form.startswith("%d") else (lambda x, i: F.concat(F.lit("- "), x))
            section(heading, F.array_join(F.transform(name, entry), "\n"), F.size(name) > 0)
    note = F.concat(*[F.coalesce(p, F.lit("")) for p in pieces])
    return F.coalesce("notes_markdown", note) if "notes_markdown" in have else note


def compiled_notes(topics: DataFrame, title: Column) -> DataFrame:
    """(video_id, notes): the notes of a lecture's topics under its title, in order of topic_id."""
    rows = topics.select("video_id", "topic_id", title.alias("lecture"), F.concat(topic_note(topics), F.lit("---\n")).alias("note"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("topic_id", "note"))), lambda x: x["note"]), "\n")
    return rows.groupBy("video_id").agg(F.concat(F.lit("# "), F.min("lecture"), F.lit("\n\n## Detailed Notes\n\n"), body).alias("notes"))
