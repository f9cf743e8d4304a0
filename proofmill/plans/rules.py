"""Rules as one plan: records answer the atoms of all rules once, answers are counted by (package, subject, atom), and
joined to a frame of all (subject, rule) pairs, so that rules without any record have an outcome too.

records:    package_id, record_id, record_type, timestamp, lifecycle_phase, obligation_role, subject_refs,
            component_refs, dataset_refs, actor_refs, payload (JSON text), attachments (path, media_type,
            attachment_type), attestation_signature, seq
subjects:   package_id, subject_id, risk, modalities
packages:   package_id, package_time
signatures: package_id, alg

Joins are on counts, a row per package, subject and atom at most. Answers are aggregated before they are shuffled, so
neither a hot package nor a hot subject gathers its records in one task. Evidence of records without a subject is every
subject's; it is joined last, and nothing is shuffled after it has been copied to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .atoms import Atoms, answered, atoms_of
from .catalog import Rule

#: Keys of counts that aren't of one subject: records without a subject, and all records of a package.
SHARED, ALL = "\u0000shared", "\u0000all"
NOBODY = "\u0000nobody"
_TABLE = (
    "rule int, profile_id string, provision_id string, rule_id string, severity string, message string, existential boolean, min_count int, signed boolean, algs array<string>, "
    "defect string, late boolean, if_system_type array<string>, risks array<string>, needs array<string>, applicable_to array<string>, package_scope boolean, atom int"
)
_REFS = "array<struct<seq:bigint,record_id:string>>"
_COUNTS = ("n", "ok", "bad", "refs")


def rule_table(spark: SparkSession, rules: list[Rule], atoms: Atoms, instant: str) -> DataFrame:
    """The rules as rows; what doesn't depend on data is decided here."""
    rows = []
    for i, r in enumerate(rules):
        defect, least = atoms.defects.get(i), 1
        try:
            least = r.min_count
        except (TypeError, ValueError) as e:
            defect = defect or str(e)
        algs = r.params.get("required_alg")
        late = bool(r.if_effective and r.effective_date is not None and instant < r.effective_date)
        rows.append((
            i, r.profile_id, r.provision_id, r.rule_id, r.severity, r.message, r.existential, least, r.operator == "bundle_signed", [algs] if isinstance(algs, str) else list(algs or []),
            defect, late, list(r.if_system_type), list(r.risks), list(r.modalities), list(r.applicable_to), r.package_scope, atoms.of_rule.get(i),
        ))
    return spark.createDataFrame(rows, _TABLE)


def _keys(refs: Column) -> Column:
    """The subjects that a record counts for; SHARED if it names none."""
    refs = F.coalesce(F.array_distinct(refs), F.array().cast("array<string>"))
    return F.when(F.size(refs) == 0, F.array(F.lit(SHARED))).otherwise(refs)


def flagged(records: DataFrame, packages: DataFrame, rules: list[Rule], instant: str) -> DataFrame:
    """(package_id, key, rule, seq, record_id, satisfied): a row for each record, rule in whose scope it is, and key."""
    atoms = atoms_of(rules, instant)
    of_atom = records.sparkSession.createDataFrame([(a, r) for r, a in atoms.of_rule.items()], "atom int, rule int")
    rows = answered(records, packages, atoms).join(F.broadcast(of_atom), "atom")
    return rows.select("package_id", F.explode(F.concat(_keys(F.col("subject_refs")), F.array(F.lit(ALL)))).alias("key"), "rule", "seq", "record_id", "satisfied")


def evidence_rows(records: DataFrame, packages: DataFrame, rules: list[Rule], instant: str) -> DataFrame:
    """(package_id, key, rule, seq, record_id) of satisfying records, for any number of them."""
    return flagged(records, packages, rules, instant).where("satisfied").drop("satisfied")


def _counts(records: DataFrame, packages: DataFrame, atoms: Atoms, evidence: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(own, shared, whole): matching, satisfying and failing records of each atom by subject, without a subject, and of the
    package. Atoms that are asked of packages alone aren't counted by subject.

    The three are read from one shuffle of the counts. So they tell rows apart by an aggregate: a condition on the key
    would be moved to the records, which would be answered three times."""
    none, whole = F.array().cast(_REFS), F.array(F.lit(ALL))
    keys = F.when(F.col("asked"), F.concat(_keys(F.col("subject_refs")), whole)).otherwise(whole)
    rows = answered(records, packages, atoms).select("package_id", "record_id", "seq", "atom", "satisfied", "fails", F.explode(keys).alias("key"))
    # never null, so that no condition of the joins goes to the records either; a reference that is null is no subject's
    rows = rows.withColumn("key", F.coalesce("key", F.lit(NOBODY)))
    of = F.when(F.col("key") == SHARED, 1).when(F.col("key") == ALL, 2).otherwise(0)
    one = F.struct(F.col("seq").cast("long").alias("seq"), F.col("record_id").cast("string").alias("record_id"))
    refs = [F.collect_list(F.when(F.col("satisfied"), one)).cast(_REFS).alias("refs")] if evidence else []
    counted = rows.groupBy("package_id", "key", "atom").agg(F.max(of).alias("of"), F.count("*").alias("n"), F.count_if("satisfied").alias("ok"), F.count_if("fails").alias("bad"), *refs)
    # in order once here, so that lists of several keys are merged and not sorted anew for each subject
    counted = counted.withColumn("refs", F.sort_array("refs") if evidence else none)
    some = lambda which, *names: counted.where(F.col("of") == which).select("package_id", *names, "atom", *[F.col(c).alias(f"{c}{which + 1}") for c in _COUNTS])
    return some(0, F.col("key").alias("subject_id")), some(1), some(2)


def is_selected(declared: Column, provision: Column) -> Column:
    """Whether a profile's declared provisions, if there are any, have this one: by exact id or as a parent."""
    part = lambda d: (d == provision) | d.startswith(F.concat(provision, F.lit("."))) | d.startswith(F.concat(provision, F.lit("-")))
    return F.coalesce(F.size(declared) == 0, F.lit(True)) | F.coalesce(F.exists(declared, part), F.lit(False))


def _asked_of_all(packages: DataFrame, subjects: DataFrame, rules: list[Rule]) -> DataFrame:
    """All profiles of the rules, asked of each package."""
    names = sorted({r.profile_id for r in rules})
    every = packages.select("package_id").union(subjects.select("package_id")).distinct()
    return every.select("package_id", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("profile_id"), F.lit(None).cast("array<string>").alias("declared"))


def rule_results(records: DataFrame, subjects: DataFrame, packages: DataFrame, rules: list[Rule], instant: str, signatures: DataFrame | None = None, evidence: bool = True, asked: DataFrame | None = None) -> DataFrame:
    """A row for each package, subject and rule that applies: outcome passed, failed, skipped or error.

    asked: the profiles of each package and the provisions it declares (package_id, profile_id, declared); without it
    all rules are asked of all packages. Rules of package scope, and all rules of packages without subjects, are
    evaluated once with a null subject_id over all records; else a subject's records are its own and those without a
    subject. evidence adds the satisfying record ids in order, gathered in one row; leave it out where those can be very
    many and use evidence_rows. A rule is an error if a record can't be judged by it: a date without a zone against one
    with a zone, an unknown kind of entity.
    """
    spark = records.sparkSession
    atoms = atoms_of(rules, instant)
    own, shared, whole = _counts(records, packages, atoms, evidence)
    table = F.broadcast(rule_table(spark, rules, atoms, instant))
    asked = _asked_of_all(packages, subjects, rules) if asked is None else asked.select("package_id", "profile_id", "declared")

    subjects = subjects.select("package_id", F.col("subject_id").cast("string").alias("subject_id"), F.coalesce("risk", F.lit("")).alias("risk"), F.coalesce("modalities", F.array().cast("array<string>")).alias("modalities"))
    listed = subjects.groupBy("package_id").agg(F.count("*").alias("many"))
    alone = packages.select("package_id").distinct().join(listed, "package_id", "left").select("package_id", F.lit(None).cast("string").alias("subject_id"), F.lit("").alias("risk"), F.array().cast("array<string>").alias("modalities"), F.col("many").isNull().alias("only"))
    by_alg = None
    if signatures is not None:
        by_alg = signatures.groupBy("package_id", F.coalesce("alg", F.lit("")).alias("alg")).agg(F.count("*").alias("c")).groupBy("package_id").agg(F.map_from_entries(F.collect_list(F.struct("alg", "c"))).alias("signed_by"))

    def frame(who: DataFrame) -> DataFrame:
        """The rules that are asked of packages or subjects."""
        df = who.join(asked, "package_id").join(table, "profile_id")
        df = df.where(is_selected(F.col("declared"), F.col("provision_id")) & ((F.col("risk") == "") | (F.size("applicable_to") == 0) | F.array_contains("applicable_to", F.col("risk"))))
        if by_alg is None:
            return df.withColumn("signed_by", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))
        return df.join(by_alg, "package_id", "left")

    of_subjects = frame(subjects.withColumn("only", F.lit(False))).where(F.col("subject_id").isNotNull() & ~F.col("package_scope")).join(own, ["package_id", "subject_id", "atom"], "left").join(shared, ["package_id", "atom"], "left")
    of_packages = frame(alone).where(F.col("package_scope") | F.col("only")).join(whole, ["package_id", "atom"], "left")
    df = of_subjects.unionByName(of_packages, allowMissingColumns=True)

    package = F.col("subject_id").isNull()
    off = (F.size("needs") > 0) & (F.size("modalities") > 0) & ~F.arrays_overlap("needs", "modalities")
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = lambda c: F.when(off, 0).otherwise(F.when(package, zero(F.col(f"{c}3"))).otherwise(zero(F.col(f"{c}1")) + zero(F.col(f"{c}2"))))
    signs = F.aggregate(F.map_entries(F.map_filter("signed_by", lambda k, v: (F.size("algs") == 0) | F.array_contains("algs", k))), F.lit(0).cast("long"), lambda acc, e: acc + e["value"])
    df = df.withColumns({"n_match": F.when(F.col("signed"), F.coalesce(signs, F.lit(0))).otherwise(both("n")), "n_satisfied": F.when(F.col("signed"), F.coalesce(signs, F.lit(0))).otherwise(both("ok"))})
    skip = F.col("late") | ((F.col("risk") != "") & (F.size("if_system_type") > 0) & ~F.array_contains("if_system_type", F.col("risk"))) | ((F.size("risks") > 0) & ~F.array_contains("risks", F.col("risk")))
    passed = F.when(F.col("existential"), F.col("n_satisfied") >= F.col("min_count")).otherwise(F.col("n_satisfied") == F.col("n_match"))
    outcome = F.when(skip, "skipped").when(F.col("defect").isNotNull() | (both("bad") > 0), "error").when(passed, "passed").otherwise("failed")
    none = F.array().cast(_REFS)
    order = F.sort_array(F.when(package, F.coalesce("refs3", none)).otherwise(F.concat(F.coalesce("refs2", none), F.coalesce("refs1", none))))
    ids = F.when(off | (outcome == "skipped"), F.array().cast("array<string>")).otherwise(order["record_id"]) if evidence else F.array().cast("array<string>")
    return df.select("package_id", "subject_id", "profile_id", "provision_id", "rule_id", "severity", "message", "n_match", "n_satisfied", outcome.alias("outcome"), ids.alias("evidence_refs"), "rule")
