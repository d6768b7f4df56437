"""Augmented dialogues -> training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.functions import knowledge_text as K
from lorewell.functions import lines as L
from lorewell.operators.ordered import dense_rank_by_digest, running, with_neighbour

LONG_EPISODE = 100
# The rules of a key:value line, by the words their messages begin with.
RULES = ("eval_labels", "missing text", "missing labels", "missing concepts")


# --- key:value lines -------------------------------------------------------


def validate_examples(lines: DataFrame) -> DataFrame:
    """Parse `key:value` lines; `errors` names every rule a line breaks, with its number."""
    parsed = lines.filter(F.col("line") != "").withColumn("fields", L.tab_fields("line"))
    f = F.col("fields")

    def missing(key: str) -> Column:
        message = F.concat(F.lit(f"missing {key} in line "), F.col("line_no").cast("string"))
        return F.when(L.field_value(f, key).isNull(), message)

    eval_labels = F.when(
        L.field_value(f, "eval_labels").isNotNull(),
        F.concat(F.lit("eval_labels in line "), F.col("line_no").cast("string")),
    )
    errors = F.array_compact(
        F.array(eval_labels, missing("text"), missing("labels"), missing("concepts"))
    )
    return parsed.withColumn("errors", errors)


def bst_examples(lines: DataFrame, skip_empty: bool = False) -> DataFrame:
    """Valid lines as examples with knowledge behind the text, numbered by episode.

    An episode ends with a line marked done, valid or not; the last valid line of each is
    closed. `n_lines` is the last line of the file, valid or not.
    """
    parsed = validate_examples(lines)
    f = F.col("fields")
    items = K.parse_items(L.unescape_field(L.field_value(f, "concepts")))
    done = F.coalesce(L.field_value(f, "episode_done"), F.lit("")) != ""
    labels = F.transform(F.split(L.field_value(f, "labels"), "\\|", -1), L.unescape_field)
    rows = parsed.select(
        "file",
        "line_no",
        K.append_knowledge(
            L.unescape_field(L.field_value(f, "text")), items, skip_empty
        ).alias("text"),
        labels.alias("labels"),
        done.alias("done"),
        (F.size("errors") == 0).alias("valid"),
    )
    ended = F.col("done").cast("bigint")
    numbered = running(rows, ["file"], "line_no", sums={"_ended": ended}).withColumn(
        "episode_id", F.col("_ended") - ended
    )
    # One row per episode and per file, found in one pass each.
    last = numbered.filter("valid").groupBy("file", "episode_id").agg(F.max("line_no").alias("_last"))
    files = numbered.groupBy("file").agg(F.max("line_no").alias("n_lines"))
    closed = numbered.filter("valid").join(last, ["file", "episode_id"]).join(files, "file")
    return closed.select(
        "file",
        "episode_id",
        "line_no",
        "text",
        "labels",
        (F.col("line_no") == F.col("_last")).alias("episode_done"),
        "n_lines",
    )


def error_counts() -> list[Column]:
    """Aggregates over validated lines: `lines`, `bad`, and how often each rule was broken."""

    def broken(rule: str) -> Column:
        hit = F.exists("errors", lambda e: e.startswith(rule))
        return F.count_if(hit).alias(rule.replace(" ", "_"))

    return [F.count("*").alias("lines"), F.count_if(F.size("errors") > 0).alias("bad"), *map(broken, RULES)]


def raise_on_errors(validated: DataFrame) -> DataFrame:
    """Strict reading: a line with an error ends the job when it is reached."""
    checked = F.when(
        F.size("errors") > 0, F.raise_error(F.array_join("errors", "; "))
    ).otherwise(F.col("errors"))
    return validated.withColumn("errors", checked)


def episode_stats(examples: DataFrame) -> DataFrame:
    """Examples and episodes per file; flags a file that looks like one long episode."""
    stats = examples.groupBy("file").agg(
        F.count("*").alias("n_examples"),
        F.count_distinct("episode_id").alias("n_episodes"),
        F.max("n_lines").alias("n_lines"),
    )
    one_long = (F.col("n_episodes") == 1) & (F.col("n_lines") > LONG_EPISODE)
    return stats.withColumn("one_long_episode", one_long)


# --- comma-split lines -----------------------------------------------------


def pair_turns(lines: DataFrame) -> DataFrame:
    """Neighbouring lines with the same id: `prev` is the context, `cur` the answer.

    `run_start` is the line where the unbroken run of this id begins; the same
    id further down is another run.
    """
    fields = F.split(L.strip_space("line"), ",", -1)
    parsed = lines.select("file", "line_no", fields.alias("cur")).withColumn(
        "id", F.get("cur", F.lit(0))
    )
    pairs = with_neighbour(parsed, ["file"], "line_no", {"prev": "cur", "prev_id": "id"})
    starts = F.when(
        F.col("prev_id").isNull() | (F.col("prev_id") != F.col("id")), F.col("line_no")
    )
    runs = running(pairs, ["file"], "line_no", maxima={"run_start": starts})
    return runs.filter(F.col("prev_id") == F.col("id")).select(
        "file", "run_start", "line_no", "prev", "cur"
    )


def check_turns(pairs: DataFrame) -> DataFrame:
    """Add `error`: turns must count up from 1 along the run, and fields must be 9 or 10."""
    turn = F.get("cur", F.lit(1)).try_cast("bigint")
    before = F.get("prev", F.lit(1)).try_cast("bigint")
    place = F.col("line_no") - F.col("run_start") + 1
    good = F.coalesce((before + 1 == turn) & (turn == place), F.lit(False))
    return pairs.withColumn("turn", turn).withColumn(
        "error",
        F.when(~good, F.lit("turns out of order")).when(
            ~F.size("cur").isin(9, 10), F.lit("wrong number of fields")
        ),
    )


def bad_runs(checked: DataFrame) -> DataFrame:
    """Runs with at least one error: the quarantine."""
    return (
        checked.filter(F.col("error").isNotNull())
        .groupBy("file", "run_start")
        .agg(F.min_by("error", "line_no").alias("error"), F.count("*").alias("n_errors"))
    )


def ed_candidates(fields: Column) -> Column:
    """Candidates of a line with ten fields, else none."""
    cell = F.get(fields, F.lit(8))
    listed = F.transform(F.split(cell, "\\|", -1), K.unescape_separators)
    return F.when((F.size(fields) == 10) & (cell != ""), listed).otherwise(
        F.array().cast("array<string>")
    )


def ed_examples(pairs: DataFrame, skip_empty: bool = False) -> DataFrame:
    """Pairs of sound runs as examples, marked by the role that speaks in the context."""
    checked = check_turns(pairs)
    sound = checked.join(
        bad_runs(checked).select("file", "run_start"), ["file", "run_start"], "left_anti"
    )
    prev, cur = F.col("prev"), F.col("cur")
    political = F.contains(F.get(prev, F.lit(7)), F.lit("<POLITICAL>")) | F.contains(
        F.get(cur, F.lit(7)), F.lit("<POLITICAL>")
    )
    role = F.when(F.col("turn") % 2 == 0, F.lit("experiencer")).otherwise(F.lit("responder"))
    text = K.append_knowledge(
        K.unescape_commas(F.get(prev, F.lit(5))),
        K.parse_items(F.element_at(prev, -1)),
        skip_empty,
    )
    return sound.select(
        "file",
        "run_start",
        "line_no",
        "turn",
        text.alias("text"),
        K.unescape_commas(F.get(cur, F.lit(5))).alias("label"),
        F.get(cur, F.lit(2)).alias("prompt"),
        K.unescape_commas(F.get(cur, F.lit(3))).alias("situation"),
        ed_candidates(cur).alias("candidates"),
        political.alias("is_political"),
        role.alias("context_role"),
    )


def attach_row_vectors(
    pairs: DataFrame, vectors: DataFrame, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Context and label vectors by row: the header has none, so line n has vector n - 2."""
    out = pairs
    for name, offset in (("context_vec", 3), ("label_vec", 2)):
        side = vectors.select(*keys, F.col("row").alias("_row"), F.col("embedding").alias(name))
        out = out.withColumn("_row", F.col("line_no") - offset).join(
            side, [*keys, "_row"], "left"
        )
    return out.drop("_row")


def top_label_prefix(scores: DataFrame, k: int = 1) -> DataFrame:
    """The k best labels per id as a text, worst first, each without its prefix."""
    best = W.partitionBy("id").orderBy(F.desc("score"), "label")
    ranked = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    short = F.substring_index("label", "_", -1)
    lists = ranked.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), short.alias("l")))).alias(
            "ls"
        )
    )
    words = F.transform("ls", lambda x: F.concat(x["l"], F.lit(" ")))
    return lists.select("id", F.array_join(words, "").alias("prefix"))


# --- nested episodes -------------------------------------------------------


def pair_dialog(
    episodes: DataFrame, speaker: str = "both", keys: tuple[str, ...] = ("file", "episode_id")
) -> DataFrame:
    """Entries (2e, 2e + 1) of a dialog, one later when the wanted speaker opens it."""
    opens = (
        F.contains(F.lower(F.get("dialog", F.lit(0))["speaker"]), F.lit(speaker.lower()))
        if speaker != "both"
        else F.lit(False)
    )
    shift = opens.cast("int")
    n = F.floor((F.size("dialog") - shift) / F.lit(2)).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(
        numbers,
        lambda e: F.struct(
            e.cast("bigint").alias("entry_no"),
            F.get("dialog", e * 2 + shift).alias("first"),
            F.get("dialog", e * 2 + shift + 1).alias("second"),
            (e == n - 1).alias("episode_done"),
        ),
    )
    others = [c for c in episodes.columns if c not in (*keys, "dialog")]
    return episodes.select(*keys, *others, F.inline(pairs))


def topic_prefix(entry_no: Column, topic: Column, text: Column) -> Column:
    opened = F.concat(F.coalesce(topic, F.lit("")), F.lit("\n"), text)
    return F.when(entry_no == 0, opened).otherwise(text)


def wow_examples(
    episodes: DataFrame,
    speaker: str = "both",
    add_topic: bool = False,
    keys: tuple[str, ...] = ("file", "episode_id"),
    skip_empty: bool = False,
) -> DataFrame:
    """Nested episodes as examples; `concepts` may be a list or a rendered cell."""
    pairs = pair_dialog(episodes, speaker, keys)
    entry = episodes.schema["dialog"].dataType.elementType
    concepts = F.col("first.concepts") if "concepts" in entry.fieldNames() else F.lit("")
    if "concepts" in entry.fieldNames() and entry["concepts"].dataType.typeName() == "array":
        items = F.coalesce(concepts, F.array().cast("array<string>"))
    else:
        items = K.parse_items(concepts)
    text = K.append_knowledge(F.col("first.text"), items, skip_empty)
    if add_topic:
        text = topic_prefix(F.col("entry_no"), F.col("chosen_topic"), text)
    extra = []
    if "label_candidates" in episodes.columns:
        extra.append(F.col("label_candidates"))
    if speaker == "wizard":
        extra.append(F.coalesce("chosen_topic", F.lit("")).alias("chosen_topic"))
    return pairs.select(
        *keys,
        "entry_no",
        text.alias("text"),
        F.array(F.col("second.text")).alias("labels"),
        "episode_done",
        *extra,
    )


# --- numbered lines --------------------------------------------------------


def convai_examples(lines: DataFrame, use_candidates: bool = True) -> DataFrame:
    """Numbered lines as they are: text, labels and candidates; number 1 opens an episode."""
    head = L.numbered_head("line")
    rest = F.split("line", "\t", -1)
    number = F.regexp_extract(head, r"^(\d+)", 1).try_cast("bigint")
    opens = F.when(number == 1, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    numbered = running(lines, ["file"], "line_no", sums={"_opened": opens})

    def piped(i: int) -> Column:
        cell = F.get(rest, F.lit(i))
        return F.when(cell.isNull() | (cell == ""), F.array().cast("array<string>")).otherwise(
            F.split(cell, "\\|", -1)
        )

    columns = [
        F.col("file"),
        (F.col("_opened") - 1).alias("episode_id"),
        F.col("line_no"),
        number.alias("number"),
        F.regexp_replace(head, r"^\d+ ", "").alias("text"),
        piped(1).alias("labels"),
        F.contains("line", F.lit("persona:")).alias("is_persona"),
    ]
    if use_candidates:
        columns.append(piped(3).alias("label_candidates"))
    return numbered.select(*columns)


def sample_contexts(
    episodes: DataFrame, contexts: DataFrame, seed: int = 0, episode: str = "episode_id"
) -> DataFrame:
    """One context per episode, drawn by a digest of seed and episode: the same on every run.

    `contexts` needs a unique `context_id`; its rows are numbered by digest.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("context_id").cast("string")))
    numbered = dense_rank_by_digest(contexts.withColumn("_d", digest), [], "_d", "_no").drop("_d")
    n = contexts.select(F.count("*").alias("n")).scalar()
    drawn = F.conv(
        F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(episode).cast("string"))), 1, 15), 16, 10
    ).cast("bigint")
    return episodes.withColumn("_no", drawn % n + 1).join(numbered, "_no").drop("_no")
