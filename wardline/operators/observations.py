"""Observation operators: many (question, field) lookups in one grouped pass.

A report lists what it wants per grain (encounter, observation group, visit,
person); ``collect_obs`` turns the list into a single aggregate.  Every pick has a
total order, so results do not depend on how the rows are laid out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.sweeps import asof_backward

OBS_ORDER = ("obs_datetime", "obs_id")


@dataclass(frozen=True)
class Want:
    """One output column of an observation pivot."""

    column: str
    how: str
    concepts: tuple
    field: str | None = None
    answers: tuple = ()
    separator: str = " | "
    top_level: bool = False
    since: bool = False

    def top(self) -> "Want":
        """The same, reading only observations outside any group."""
        return replace(self, top_level=True)


def _ids(value) -> tuple:
    return tuple(value) if isinstance(value, (list, tuple, set, range)) else (value,)


def number(column: str, concept) -> Want:
    """Latest numeric value."""
    return Want(column, "latest", _ids(concept), "value_numeric")


def text(column: str, concept) -> Want:
    """Latest free text."""
    return Want(column, "latest", _ids(concept), "value_text")


def when(column: str, concept) -> Want:
    """Latest date-time value."""
    return Want(column, "latest", _ids(concept), "value_datetime")


def coded(column: str, concept) -> Want:
    """Latest answer as its concept id."""
    return Want(column, "latest", _ids(concept), "value_coded")


def label(column: str, concept, answers=()) -> Want:
    """Latest answer as its label, optionally among given answers."""
    return Want(column, "latest", _ids(concept), "label", _ids(answers) if answers != () else ())


def peak(column: str, concept, field: str = "value_numeric", answers=()) -> Want:
    """Largest value (of any field) among the answers."""
    return Want(column, "max", _ids(concept), field, _ids(answers) if answers != () else ())


def answer_list(column: str, concept, separator: str = " | ", answers=()) -> Want:
    """All distinct answer labels in label order."""
    return Want(column, "list", _ids(concept), "label", _ids(answers) if answers != () else (), separator)


def yes_no(column: str, concept, yes, no) -> Want:
    """True / false / null from a yes/no answer; yes wins over no."""
    return Want(column, "yes_no", _ids(concept), answers=(yes, no))


def answered(column: str, concept, answer) -> Want:
    """Whether the question has this answer; false when absent."""
    return Want(column, "answered", _ids(concept), answers=_ids(answer))


def answered_or_null(column: str, concept, answer) -> Want:
    """True when the question has this answer, null when absent."""
    return Want(column, "answered_or_null", _ids(concept), answers=_ids(answer))


def answer_label(column: str, concept, answer) -> Want:
    """Label of the answer when present, else null."""
    return Want(column, "max", _ids(concept), "label", _ids(answer))


def remark(column: str, concept, answer) -> Want:
    """Latest comment on this answer."""
    return Want(column, "latest", _ids(concept), "comments", _ids(answer))


def tally(column: str, concept, answer=()) -> Want:
    """How many observations give the answer."""
    return Want(column, "count", _ids(concept), answers=_ids(answer) if answer != () else ())


def group_of(column: str, concept, answer) -> Want:
    """Lowest group id holding the answer."""
    return Want(column, "min", _ids(concept), "obs_group_id", _ids(answer))


def preferred(column: str, concept, answers: Sequence) -> Want:
    """Label of the answer that comes first in a preference list."""
    return Want(column, "preferred", _ids(concept), "label", _ids(answers))


def section(column: str, questions: Sequence = (), answers: Sequence = ()) -> Want:
    """True when any of the questions, or any of the answers to any question, occurs; else null."""
    return Want(column, "section", _ids(questions), answers=_ids(answers))


def yes_questions(column: str, questions: Sequence, yes, separator: str = "|") -> Want:
    """Labels of the ungrouped questions answered yes."""
    return Want(column, "list", _ids(questions), "question_label", _ids(yes), separator, top_level=True)


def _literal(value) -> str:
    if isinstance(value, bool) or value is None or isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _among(column: str, values: Sequence) -> str:
    return f"{column} IN ({', '.join(_literal(v) for v in values)})"


def _hit(want: Want, cells: bool = False) -> str:
    tests = [_among("concept_id", want.concepts)]
    if want.answers and want.how != "yes_no":
        tests.append(_among("value_coded", want.answers))
    if want.top_level:
        tests.append("_top" if cells else "obs_group_id IS NULL")
    if want.since:
        tests.append("_recent")
    return " AND ".join(tests)


def joined_labels(collected: Column, separator: str) -> Column:
    """Collected labels as one text; null when there are none."""
    return F.when(F.size(collected) > 0, F.array_join(F.array_sort(collected), separator))


def want_column(want: Want, order: Sequence[str] = OBS_ORDER, cells: bool = False) -> Column:
    """The aggregate of one want over observations, or over cells of them.

    Written as SQL text: a report has hundreds of these, and one parsed expression
    each builds far faster than a dozen column calls.
    """
    field, hit = want.field, _hit(want, cells)
    coded = field in ("label", "value_coded")
    if want.how == "latest" and cells and not coded:
        text = f"max(CASE WHEN {hit} THEN _latest_{field} END)._value"
    elif want.how == "latest":
        rank = "'_when', _when" if cells else ", ".join(f"{_literal(o)}, {o}" for o in order)
        text = f"max(CASE WHEN {hit} AND {field} IS NOT NULL THEN named_struct({rank}, '_value', {field}) END)._value"
    elif want.how in ("max", "min"):
        text = f"{want.how}(CASE WHEN {hit} THEN {f'_{want.how}_{field}' if cells and not coded else field} END)"
    elif want.how == "list":
        collected = f"collect_set(CASE WHEN {hit} THEN {field} END)"
        text = f"CASE WHEN size({collected}) > 0 THEN array_join(array_sort({collected}), {_literal(want.separator)}) END"
    elif want.how == "yes_no":
        yes, no = (_literal(v) for v in want.answers)
        text = f"max(CASE WHEN {hit} THEN CASE value_coded WHEN {yes} THEN true WHEN {no} THEN false END END)"
    elif want.how == "answered":
        text = f"coalesce(bool_or({hit}), false)"
    elif want.how == "answered_or_null":
        text = f"bool_or(CASE WHEN {hit} THEN true END)"
    elif want.how == "count":
        text = f"sum(CASE WHEN {hit} THEN _n ELSE 0 END)" if cells else f"count_if({hit})"
    elif want.how == "preferred":
        ranks = " ".join(f"WHEN {_literal(v)} THEN {i}" for i, v in enumerate(want.answers))
        text = f"min(CASE WHEN {hit} THEN struct(CASE value_coded {ranks} END, {'_min_obs_id' if cells else 'obs_id'}, label) END).label"
    elif want.how == "section":
        tests = [_among("concept_id", want.concepts)] if want.concepts else []
        tests += [f"coalesce({_among('value_coded', want.answers)}, false)"] if want.answers else []
        text = f"bool_or(CASE WHEN {' OR '.join(tests)} THEN true END)"
    else:
        raise ValueError(f"unknown pick {want.how!r}")
    return F.expr(text).alias(want.column)


def _columns_read(wants: Sequence[Want], order: Sequence[str]) -> set[str]:
    read = {"concept_id"}
    for want in wants:
        if want.how == "latest":
            read.update(order)
        if want.how == "preferred":
            read.add("obs_id")
        if want.field and want.field not in ("label", "question_label"):
            read.add(want.field)
        if want.answers or want.field == "label":
            read.add("value_coded")
        if want.top_level:
            read.add("obs_group_id")
        if want.since:
            read.add("obs_datetime")
    return read


def _labelled(rows: DataFrame, wants: Sequence[Want], label_table: DataFrame | None) -> DataFrame:
    """Add the label columns the wants read."""
    if any(want.field in ("label", "question_label") for want in wants) and label_table is None:
        raise ValueError("labels are wanted but no label table was given")
    if any(want.field == "label" for want in wants):
        rows = with_labels(rows, label_table)
    questions = sorted({c for want in wants if want.field == "question_label" for c in want.concepts})
    if questions:
        asked = label_table.filter(F.col("concept_id").isin(questions))
        rows = with_labels(rows, asked, on="concept_id", out="question_label")
    return rows


def obs_subset(obs: DataFrame, anchors: DataFrame, key: str = "encounter_id") -> DataFrame:
    """Live observations of the anchor rows."""
    return obs.filter(~F.col("voided")).join(anchors.select(key), key, "left_semi")


def with_labels(obs: DataFrame, label_table: DataFrame, on: str = "value_coded", out: str = "label") -> DataFrame:
    side = label_table.select(F.col("concept_id").alias("_concept"), F.col("label").alias(out))
    return obs.join(side, obs[on] == side["_concept"], "left").drop("_concept")


# Pivots of more columns than this go through cells, unless the caller says otherwise.
WIDE = 24


def _cells(rows: DataFrame, keys: Sequence[str], wants: Sequence[Want], order: Sequence[str]) -> DataFrame:
    """One narrow row per key, question and answer with what the wants need of it."""
    grouping = [*keys, "concept_id"]
    if "value_coded" in rows.columns:
        grouping.append("value_coded")
    if any(want.top_level for want in wants):
        rows = rows.withColumn("_top", F.col("obs_group_id").isNull())
        grouping.append("_top")
    if any(want.since for want in wants):
        grouping.append("_recent")
    rank = f"struct({', '.join(order)})"
    facts = {}
    for want in wants:
        coded = want.field in ("label", "value_coded")
        if want.how == "latest" and coded:
            facts["_when"] = f"max({rank})"
        elif want.how == "latest":
            value = f"struct({', '.join(order)}, {want.field} AS _value)"
            facts[f"_latest_{want.field}"] = f"max(CASE WHEN {want.field} IS NOT NULL THEN {value} END)"
        elif want.how in ("max", "min") and not coded:
            facts[f"_{want.how}_{want.field}"] = f"{want.how}({want.field})"
        elif want.how == "count":
            facts["_n"] = "count(1)"
        elif want.how == "preferred":
            facts["_min_obs_id"] = "min(obs_id)"
    if not facts:
        return rows.select(*grouping).distinct()
    return rows.groupBy(*grouping).agg(*[F.expr(text).alias(name) for name, text in facts.items()])


def collect_obs(
    obs: DataFrame, key: str | Sequence[str], wants: Sequence[Want],
    label_table: DataFrame | None = None, order: Sequence[str] = OBS_ORDER, since: Column | None = None, wide_from: int = WIDE,
) -> DataFrame:
    """One row per key with every wanted column, from one read of the observations.

    Only the questions asked for are read, so the concept filter and the column
    list reach the scan (a section with answers looks at every question).
    ``since`` is the earliest time for wants that carry the ``since`` mark.

    Narrow pivots are one aggregate.  In a wide one a partial row is mostly empty
    columns, so map-side combine would shuffle far more than it saves: there the
    observations shrink to one cell per question and answer first, the cells are
    shuffled by key, and only then spread.  A busy key holds at most as many cells
    as there are questions and answers.  Both ways give the same rows; ``wide_from``
    is the number of columns above which the second is taken.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if not any(want.how == "section" and want.answers for want in wants):
        obs = obs.filter(F.col("concept_id").isin(sorted({c for want in wants for c in want.concepts})))
    rows = obs.select(*sorted(_columns_read(wants, order) | set(keys)))
    if since is not None:
        rows = rows.withColumn("_recent", F.col("obs_datetime") >= since)
    by_label = all(want.field in ("label", "question_label") for want in wants if want.how == "list")
    wide = len(wants) > wide_from and by_label
    if wide:
        rows = _cells(rows, keys, wants, order).repartition(*keys)
    rows = _labelled(rows, wants, label_table)
    return rows.groupBy(*keys).agg(*[want_column(want, order, wide) for want in wants])


def fill_absent(df: DataFrame, wants: Sequence[Want]) -> DataFrame:
    """False and zero for anchors without any observation after a left join."""
    fills = {}
    for want in wants:
        if want.how == "answered":
            fills[want.column] = F.coalesce(F.col(want.column), F.lit(False))
        elif want.how == "count":
            fills[want.column] = F.coalesce(F.col(want.column), F.lit(0))
    return df.withColumns(fills) if fills else df


def register(
    anchors: DataFrame, obs: DataFrame, wants: Sequence[Want], key: str = "encounter_id",
    label_table: DataFrame | None = None,
) -> DataFrame:
    """Anchor rows widened by their observation columns; no anchor is lost."""
    wide = collect_obs(obs, key, wants, label_table)
    return fill_absent(anchors.join(wide, key, "left"), wants)


def nth_obs(obs: DataFrame, key: str, concept, n: int) -> DataFrame:
    """The n-th (from 0) observation of a question per key, by obs id.

    The rank filter is a group limit: each task keeps at most n + 1 rows per key
    before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy("obs_id"))
    rows = obs.filter(F.col("concept_id") == concept)
    return rows.withColumn("_n", rank).filter(F.col("_n") <= n + 1).filter(F.col("_n") == n + 1).drop("_n")


def toplevel_only(obs: DataFrame) -> DataFrame:
    return obs.filter(F.col("obs_group_id").isNull())


def group_values(obs: DataFrame, wants: Sequence[Want], label_table: DataFrame | None = None) -> DataFrame:
    """The wanted columns per observation group."""
    return collect_obs(obs.filter(F.col("obs_group_id").isNotNull()), "obs_group_id", wants, label_table)


def first_obs(column: str, concept) -> Want:
    """Lowest observation id of a question."""
    return Want(column, "min", _ids(concept), "obs_id")


def construct_children(
    obs: DataFrame, parents: Mapping[str, object], wants: Sequence[Want],
    key: str = "encounter_id", label_table: DataFrame | None = None,
) -> DataFrame:
    """Wanted child values per key and named parent construct, as ``<parent>_<column>``.

    Children of all constructs of a kind are read together; ``group_matrix`` reads
    the first construct of each kind.
    """
    heads = obs.filter(F.col("concept_id").isin(list(parents.values())))
    heads = heads.select(F.col("obs_id").alias("obs_group_id"), F.col("concept_id").alias("_construct"))
    children = obs.join(heads, "obs_group_id")
    per_construct = collect_obs(children, [key, "_construct"], wants, label_table)
    return per_construct.groupBy(key).agg(
        *[
            F.expr(f"max(CASE WHEN _construct = {_literal(concept)} THEN {want.column} END)").alias(f"{name}_{want.column}")
            for name, concept in parents.items()
            for want in wants
        ]
    )


def group_matrix(
    obs: DataFrame, key: str, wants: Sequence[Want], constructs: Mapping[str, object] | None = None,
    leads: Mapping[str, tuple] | None = None, drugs: Mapping[str, object] | None = None,
    label_table: DataFrame | None = None, order: Sequence[str] = OBS_ORDER,
) -> DataFrame:
    """Values of chosen observation groups side by side, as ``<name>_<column>``.

    A group is chosen by the concept of its head row (``constructs``), by a
    (question, answer) it holds (``leads``) or by a drug it names (``drugs``); of
    several groups the one with the lowest id is read.  Any number of names costs
    one read of the observations and two aggregates: by group, then by key.
    """
    constructs, leads, drugs = constructs or {}, leads or {}, drugs or {}
    heads = sorted(set(constructs.values()))
    questions = sorted({c for want in wants for c in want.concepts} | {q for q, _ in leads.values()})
    read = _columns_read(wants, order) | {key, "obs_group_id", "obs_id"}
    if leads:
        read.add("value_coded")
    needed = _among("concept_id", [*questions, *heads])
    if drugs:
        read.add("value_drug")
        needed = f"{needed} OR {_among('value_drug', sorted(set(drugs.values())))}"
    rows = obs.filter(F.expr(needed)).select(*sorted(read))
    if heads:
        # A head row stands for its own group, and for its parent's as any child does.
        as_child = "CASE WHEN obs_group_id IS NOT NULL THEN struct(obs_group_id AS gid, concept_id AS question, CAST(NULL AS INT) AS head) END"
        as_head = f"CASE WHEN {_among('concept_id', heads)} THEN struct(obs_id AS gid, CAST(NULL AS INT) AS question, concept_id AS head) END"
        rows = rows.withColumn("_cell", F.expr(f"explode(array_compact(array({as_child}, {as_head})))"))
        rows = rows.withColumns({"_gid": F.col("_cell.gid"), "concept_id": F.col("_cell.question"), "_head": F.col("_cell.head")})
    else:
        rows = rows.filter(F.col("obs_group_id").isNotNull()).withColumn("_gid", F.col("obs_group_id"))
    rows = _labelled(rows, wants, label_table)
    facts = [want_column(want, order) for want in wants]
    if heads:
        facts.append(F.max("_head").alias("_head"))
    for name, (question, answer) in leads.items():
        facts.append(F.expr(f"bool_or(concept_id = {_literal(question)} AND value_coded = {_literal(answer)})").alias(f"_lead_{name}"))
    if drugs:
        listed = f"collect_set(CASE WHEN {_among('value_drug', sorted(set(drugs.values())))} THEN value_drug END)"
        facts.append(F.expr(listed).alias("_drugs"))
    groups = rows.groupBy(key, "_gid").agg(*facts)
    chosen = {name: f"_head = {_literal(concept)}" for name, concept in constructs.items()}
    chosen |= {name: f"_lead_{name}" for name in leads}
    chosen |= {name: f"array_contains(_drugs, {_literal(value)})" for name, value in drugs.items()}
    cell = ", ".join(["_gid", *[want.column for want in wants]])
    picked = groups.groupBy(key).agg(
        *[F.expr(f"min(CASE WHEN {test} THEN struct({cell}) END)").alias(f"_{name}") for name, test in chosen.items()]
    )
    spread = picked.select(key, *[
        F.col(f"_{name}.{want.column}").alias(f"{name}_{want.column}") for name in chosen for want in wants
    ], F.coalesce(*[F.col(f"_{name}._gid") for name in chosen]).alias("_any"))
    return spread.filter(F.col("_any").isNotNull()).drop("_any")


def answer_led_values(
    obs: DataFrame, key: str, leads: Mapping[str, tuple], wants: Sequence[Want], label_table: DataFrame | None = None,
) -> DataFrame:
    """Values of the group that holds each (question, answer), as ``<lead>_<column>``."""
    return group_matrix(obs, key, wants, leads=leads, label_table=label_table)


def drug_attribute_matrix(
    obs: DataFrame, key: str, drugs: Mapping[str, object], wants: Sequence[Want], label_table: DataFrame | None = None,
) -> DataFrame:
    """Attributes of the group naming each drug, as ``<drug>_<attribute>``."""
    return group_matrix(obs, key, wants, drugs=drugs, label_table=label_table)


def ranked_answers(obs: DataFrame, key: str, wants: Mapping[str, object], n: int, label_table: DataFrame) -> DataFrame:
    """The first n answers per key and question as ``<name>_1`` to ``<name>_n``.

    Questions are numbered independently, so answer i of one question need not
    belong with answer i of another; ``ranked_groups`` keeps them together.
    """
    rank = F.row_number().over(Window.partitionBy(key, "concept_id").orderBy("obs_id"))
    rows = obs.filter(F.col("concept_id").isin(list(wants.values())) & F.col("value_coded").isNotNull())
    rows = rows.select(key, "concept_id", "obs_id", "value_coded").withColumn("_n", rank).filter(F.col("_n") <= n)
    rows = with_labels(rows, label_table)
    return rows.groupBy(key).agg(
        *[
            F.expr(f"max(CASE WHEN concept_id = {_literal(concept)} AND _n = {i} THEN label END)").alias(f"{name}_{i}")
            for name, concept in wants.items()
            for i in range(1, n + 1)
        ]
    )


def ranked_groups(
    obs: DataFrame, key: str, lead: object, wants: Sequence[Want], n: int, label_table: DataFrame | None = None,
) -> DataFrame:
    """The first n groups holding the lead question, each with its own columns."""
    leads = obs.filter((F.col("concept_id") == lead) & F.col("obs_group_id").isNotNull()).groupBy(
        key, "obs_group_id"
    ).agg(F.min("obs_id").alias("_first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_first", "obs_group_id"))
    kept = leads.withColumn("_n", rank).filter(F.col("_n") <= n)
    values = collect_obs(obs.filter(F.col("obs_group_id").isNotNull()), [key, "obs_group_id"], wants, label_table)
    rows = kept.join(values, [key, "obs_group_id"], "left")
    return rows.groupBy(key).agg(
        *[
            F.max(F.when(F.col("_n") == i, F.col(want.column))).alias(f"{want.column}_{i}")
            for want in wants
            for i in range(1, n + 1)
        ]
    )


def latest_answer_lists(
    obs: DataFrame, person: str, wants: Mapping[str, object], label_table: DataFrame, separator: str = " | ",
) -> DataFrame:
    """Per person, all answers of the latest encounter that answers each question."""
    rows = obs.filter(F.col("concept_id").isin(list(wants.values())) & F.col("value_coded").isNotNull())
    rows = with_labels(rows.select(person, "encounter_id", "concept_id", "obs_datetime", "value_coded"), label_table)
    per_encounter = rows.groupBy(person, "concept_id", "encounter_id").agg(
        F.max("obs_datetime").alias("_at"), joined_labels(F.collect_set("label"), separator).alias("_list")
    )
    ranked = F.struct("_at", "encounter_id", "_list")
    return per_encounter.groupBy(person).agg(
        *[F.max(F.when(F.col("concept_id") == concept, ranked))["_list"].alias(name) for name, concept in wants.items()]
    )


def answer_ever(obs: DataFrame, person: str, wants: Mapping[str, tuple], since: Column | None = None) -> DataFrame:
    """Per person, whether each (question, answer) was ever recorded."""
    picks = [replace(answered(name, q, a), since=since is not None) for name, (q, a) in wants.items()]
    return collect_obs(obs, person, picks, since=since)


def latest_before_encounter(
    encounters: DataFrame, obs: DataFrame, concept, take: Sequence[str], by: str = "person_id",
    same_visit: bool = False,
) -> DataFrame:
    """The latest observation of a question before each encounter."""
    keys = [by, "visit_id"] if same_visit else [by]
    rows = obs.filter(F.col("concept_id") == concept).select(*keys, *OBS_ORDER, *take)
    return asof_backward(
        encounters, rows, keys, "encounter_datetime", "obs_datetime", take, order=["obs_id"], strict=True
    )


def category_symptoms(
    obs: DataFrame, key: str, question, sets: DataFrame, columns: Mapping[str, object], label_table: DataFrame,
) -> DataFrame:
    """Answers of one question split into columns by the concept set they belong to.

    When a set has several answers the one with the lowest obs id is kept.
    """
    members = sets.filter(F.col("concept_set").isin(list(columns.values()))).select(
        F.col("concept_id").alias("value_coded"), "concept_set"
    ).distinct()
    rows = obs.filter(F.col("concept_id") == question).select(key, "obs_id", "value_coded").join(members, "value_coded")
    rows = with_labels(rows, label_table)
    pick = F.struct("obs_id", "label")
    return rows.groupBy(key).agg(
        *[F.min(F.when(F.col("concept_set") == value, pick))["label"].alias(name) for name, value in columns.items()]
    )


def section_populated(obs: DataFrame, key: str, sections: Mapping[str, Mapping[str, Sequence]]) -> DataFrame:
    """Per section, true when any of its questions or answers occurs, else null."""
    wants = [section(name, rule.get("questions", ()), rule.get("answers", ())) for name, rule in sections.items()]
    return collect_obs(obs, key, wants)


def risk_factors(
    obs: DataFrame, key: str, questions: Sequence, yes, label_table: DataFrame,
    out: str = "risk_factors", separator: str = "|",
) -> DataFrame:
    """Labels of the ungrouped questions answered yes."""
    rows = collect_obs(obs, key, [yes_questions(out, questions, yes, separator)], label_table)
    return rows.filter(F.col(out).isNotNull())


def first_by_preference(
    obs: DataFrame, key: str, question, preference: Sequence, label_table: DataFrame, out: str,
) -> DataFrame:
    """Label of the answer ranked highest in a preference list."""
    rows = obs.filter(F.col("value_coded").isin(list(preference)))
    return collect_obs(rows, key, [preferred(out, question, preference)], label_table)
