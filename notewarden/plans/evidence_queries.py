"""Readings with evidence and recorded labels, on notes that Spark writes from the
customers.  The SQL states the expected values from the key and from the parts a
note is made of; it holds no pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C, clinical as K, evidence as V
from .clinical_queries import expect, wide
from .registry import Tables, query

FILLER = "catatan perawat "

# The same notes in both languages: (file, test, parts), a part being a text or
# (Spark expression, SQL expression) of the key k.
N = {
    "e": ("cast(1 + k % 4 as string)", "CAST(1 + k % 4 AS VARCHAR)"),
    "v": ("cast(1 + k % 5 as string)", "CAST(1 + k % 5 AS VARCHAR)"),
    "m": ("cast(1 + k % 6 as string)", "CAST(1 + k % 6 AS VARCHAR)"),
    "high": ("cast(40 + k % 270 as string)", "CAST(40 + k % 270 AS VARCHAR)"),
    "low": ("cast(25 + k % 180 as string)", "CAST(25 + k % 180 AS VARCHAR)"),
    "scale": ("cast(k % 47 as string)", "CAST(k % 47 AS VARCHAR)"),
    "label": ("array('TD', 'Tensi : ', 'Tekanan  Darah =', 'bp ')[int(k % 4)]", "['TD', 'Tensi : ', 'Tekanan  Darah =', 'bp '][k % 4 + 1]"),
}
LEAD = (f"repeat('{FILLER}', int(k % 20))", f"repeat('{FILLER}', CAST(k % 20 AS INTEGER))")
TAIL = (f"repeat('{FILLER}', int(k % 9))", f"repeat('{FILLER}', CAST(k % 9 AS INTEGER))")
COMA = ["GCS : E", N["e"], " V", N["v"], "M", N["m"]]
COMA_SWAPPED = ["e", N["e"], "m", N["m"], "v", N["v"]]
PRESSURE = [N["label"], N["high"], " / ", N["low"]]
SCALE = ["NIH Stroke Scale: ", N["scale"]]


def joined(parts, lang: int) -> str:
    quote = (lambda x: "'" + x + "'")
    return "concat(" + ", ".join(quote(p) if isinstance(p, str) else p[lang] for p in parts) + ")"


# emergency note: swapped or usual order of the parts of a coma score, by the key
NOTES = [
    ("cppt_igd.txt", "k % 5 in (0, 1)", [LEAD, (joined(COMA, 0), joined(COMA, 1)), " mmHg ", TAIL]),
    ("resume.txt", "k % 5 in (1, 2)", ["Pasien Sopor ", LEAD, (joined(COMA_SWAPPED, 0), joined(COMA_SWAPPED, 1)), " dan ", TAIL]),
    ("cppt_ranap.txt", "k % 3 = 0", ["koma CM ", LEAD, (joined(PRESSURE, 0), joined(PRESSURE, 1)), " mmHg ", TAIL, "TD 120/80"]),
    ("surat.txt", "k % 5 = 3", ["Glasgow Coma Scale 11, ", LEAD, (joined(SCALE, 0), joined(SCALE, 1)), " ", TAIL]),
    ("lab_1.txt", "k % 2 = 0", ["GCS 3 TD 100/70 NIHSS 1 compos mentis"]),
]


def reading_notes(t: Tables):
    k = t.spread("customer").select(F.col("c_custkey").alias("k"))
    docs = [
        F.expr(f"if({test}, named_struct('source_file', '{name}', 'text', {joined(parts, 0)}), null)") for name, test, parts in NOTES
    ]
    d = k.select(F.col("k").alias("patient_id"), F.explode(F.array_compact(F.array(*docs))).alias("d")).select("patient_id", "d.*")
    return d.withColumn("doc_type", C.doc_type_by_name("source_file"))


def around(before: str, hit: str, after: str) -> str:
    """Evidence from the parts: 100 characters on both sides, one space for many."""
    return f"trim(regexp_replace(right({before}, 100) || {hit} || left({after}, 100), '\\s+', ' ', 'g'))"


def case(*whens: tuple[str, str], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in whens) + f" ELSE {other} END"


def known(test: str, value: str, other: str = "NULL") -> str:
    """Patients without any note (no test of NOTES holds) have no row of defaults."""
    any_note = " OR ".join(f"({n[1]})" for n in NOTES)
    return f"CASE WHEN {test} THEN {value} WHEN {any_note} THEN {other} END" if other != "NULL" else f"CASE WHEN {test} THEN {value} END"


IGD, RESUME, LETTER, WARD = NOTES[0][1], "k % 5 = 2", NOTES[3][1], NOTES[2][1]
SUM = "CAST(3 + k % 4 + k % 5 + k % 6 AS VARCHAR)"
HAS_SCORE = f"{IGD} OR {RESUME} OR {LETTER}"
SWAP, EVM = joined(COMA_SWAPPED, 1), joined(COMA, 1)


@query("E-07 W-01", expect(
    gcs_initial_total=known(HAS_SCORE, case((LETTER, "'11'"), other=SUM), "'unknown'"),
    gcs_initial_text=known(HAS_SCORE, case((IGD, EVM), (RESUME, SWAP), (LETTER, "'Glasgow Coma Scale 11'")), "'unknown'"),
    gcs_eye=case((f"{IGD} OR {RESUME}", N["e"][1])), gcs_motor=case((f"{IGD} OR {RESUME}", N["m"][1])), gcs_verbal=case((f"{IGD} OR {RESUME}", N["v"][1])),
    gcs_source=case((IGD, "'cppt_igd.txt'"), (RESUME, "'resume.txt'"), (LETTER, "'surat.txt'")),
    gcs_evidence=case(
        (IGD, around(LEAD[1], EVM, f"' mmHg ' || {TAIL[1]}")), (RESUME, around(f"'Pasien Sopor ' || {LEAD[1]}", SWAP, f"' dan ' || {TAIL[1]}")),
        (LETTER, around("''", "'Glasgow Coma Scale 11'", f"', ' || {LEAD[1]} || {joined(SCALE, 1)} || ' ' || {TAIL[1]}"))),
    consciousness_text=known(f"{WARD} OR k % 5 IN (1, 2)", case((WARD, "'CM'"), other="'Sopor'"), "'unknown'")))
def gcs_readings(t: Tables):
    """Scores with the parts in either order, totals under two names, the word for
    consciousness; the best document's own evidence."""
    fields = ["gcs_initial_total", "gcs_initial_text", "gcs_eye", "gcs_motor", "gcs_verbal", "gcs_source", "gcs_evidence", "consciousness_text"]
    return wide(t, V.initial_gcs(reading_notes(t)), fields)


GOOD = "40 + k % 270 BETWEEN 50 AND 300 AND 25 + k % 180 BETWEEN 30 AND 200"
PAIR = joined(PRESSURE, 1)


@query("E-09", expect(
    blood_pressure_initial=known(WARD, case((GOOD, f"{N['high'][1]} || '/' || {N['low'][1]}"), other="'120/80'"), "'unknown'"),
    systolic_bp_initial=known(WARD, case((GOOD, N["high"][1]), other="'120'"), "'unknown'"),
    diastolic_bp_initial=known(WARD, case((GOOD, N["low"][1]), other="'80'"), "'unknown'"),
    bp_source=case((WARD, "'cppt_ranap.txt'")),
    bp_evidence=case(
        (f"{WARD} AND {GOOD}", around(f"'koma CM ' || {LEAD[1]}", PAIR, f"' mmHg ' || {TAIL[1]} || 'TD 120/80'")),
        (WARD, around(f"'koma CM ' || {LEAD[1]} || {PAIR} || ' mmHg ' || {TAIL[1]}", "'TD 120/80'", "''")))))
def pressure_readings(t: Tables):
    """Four labels; a reading out of range is passed over for the next one."""
    fields = ["blood_pressure_initial", "systolic_bp_initial", "diastolic_bp_initial", "bp_source", "bp_evidence"]
    return wide(t, V.initial_pressure(reading_notes(t)), fields)


VALID = f"{LETTER} AND k % 47 <= 42"


@query("E-10", expect(
    nihss_score=known(VALID, N["scale"][1], "'unknown'"), nihss_documented=known(VALID, "'yes'", "'no'"),
    nihss_source=case((VALID, "'surat.txt'")),
    nihss_evidence=case((VALID, around(f"'Glasgow Coma Scale 11, ' || {LEAD[1]}", joined(SCALE, 1), f"' ' || {TAIL[1]}")))))
def nihss_readings(t: Tables):
    return wide(t, V.initial_nihss(reading_notes(t)), ["nihss_score", "nihss_documented", "nihss_source", "nihss_evidence"])


# ---------------------------------------------------------------------------
# Flags: note i of a patient holds the i-th name of a flag where the key says so
# ---------------------------------------------------------------------------
GIVEN = {
    "antiplatelet_aspirin": ["Ascardia 80", "ASPIRIN tab"], "antiplatelet_clopidogrel": ["clopid", "clopidogrel 75"], "antiplatelet_cilostazol": ["cilostazol"],
    "antiplatelet_ticagrelor": ["ticagrelor"], "antikoagulan": ["inj heparin", "dabigatran"], "statin": ["Simvastatin", "obat statin"],
    "antihipertensi": ["amlodipine 10", "bisoprolol"], "mannitol": ["manitol 20%"], "citicoline": ["Sitikolin"], "ppi": ["sucralfat", "omeprazole"],
    "antibiotik": ["ceftriaxone", "metronidazole"], "antiepilepsi": ["fenitoin"], "insulin": ["lantus", "novorapid"],
}
NEAR_NAMES = "aspirinku xclopidogrel statins manitolx insulina"
RISKS = {
    "hipertensi": ["Hipertensi lama", "darah  tinggi"], "diabetes_melitus": ["kencing manis", "diabete"], "dislipidemia": ["kolesterol"], "atrial_fibrilasi": ["Atrial Fibrilasi"],
    "penyakit_jantung": ["gagal jantung", "kardiomegali"], "stroke_sebelumnya": ["riwayat stroke"], "merokok": ["perokok berat"], "obesitas": ["obesitas"],
}
ACTIONS = {
    "konsul_neurologi": ["Konsul Neurologi", "sp s"], "konsul_bedah_saraf": ["bedah saraf"], "konsul_jantung": ["EKG 12 lead", "konsul jantung"], "rawat_icu_hcu": ["intensive care"],
    "fisioterapi": ["rehab medik", "mobilisasi"], "konsul_gizi": ["ahli gizi"], "skrining_menelan": ["tes menelan"], "edukasi_keluarga": ["Informed Consent"],
}
PAST = "stroke lama dua tahun lalu tanpa sisa"


def flagged(i: int) -> str:
    return f"(k + {i}) % {i + 2} = 0"


def flag_notes(t: Tables, flags: dict[str, list[str]], near: str = ""):
    """Two files a patient; each name stands in one of them by its number."""
    lines = []
    for i, names in enumerate(flags.values()):
        lines += [(j % 2, F.expr(f"if({flagged(i)}, '{n}', null)")) for j, n in enumerate(names)]
    k = F.col("c_custkey").alias("k")
    files = [F.array_join(F.array_compact(F.array(F.lit(near), *[c for side, c in lines if side == s])), "; ") for s in (0, 1)]
    d = t.spread("customer").select(k).select(
        F.col("k").alias("patient_id"),
        F.explode(F.array(*[F.struct(F.lit(f"{n}_{s}.txt").alias("source_file"), x.alias("text")) for s, (n, x) in enumerate(zip(("lab", "resume"), files))])).alias("d"),
    )
    return d.select("patient_id", "d.*").withColumn("doc_type", C.doc_type_by_name("source_file"))


def flags_sql(flags: dict[str, list[str]], value: str) -> str:
    return expect(**{name: case((flagged(i), f"'{value}'"), other="'tidak_tercatat'") for i, name in enumerate(flags)})


@query("E-26", flags_sql(GIVEN, "diberikan"))
def drug_classes(t: Tables):
    return wide(t, V.drug_classes(flag_notes(t, GIVEN, NEAR_NAMES)), list(GIVEN))


@query("E-24", f"""SELECT r.*, CASE WHEN patient_id % 3 = 0 THEN '{PAST}' ELSE 'unknown' END AS rpd_text FROM ({flags_sql(RISKS, "ada")}) r""")
def recorded_risks(t: Tables):
    d = flag_notes(t, RISKS, "HT AF CAD dm1 afx").withColumn(
        "text", F.when((F.col("patient_id") % 3 == 0), F.concat("text", F.lit(f"\nRiwayat Penyakit Sebelumnya : {PAST}\nlanjut"))).otherwise(F.col("text"))
    )
    return wide(t, K.run_extractors(d, [V.recorded_risks, V.earlier_illness]), [*RISKS, "rpd_text"])


@query("E-25", flags_sql(ACTIONS, "dilakukan"))
def recorded_actions(t: Tables):
    return wide(t, V.recorded_actions(flag_notes(t, ACTIONS, "ICU spbsx giziku")), list(ACTIONS))
