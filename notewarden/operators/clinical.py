"""Built-in clinical extractors.

Each extractor turns one document into a short list of candidates
``(field, prio, pos, ord, value)``; a single aggregation then picks per patient
and field the first (or last) of them in the order the field asks for.  Flags
get their default from a spine of the patients.  Patterns do not span two files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as dc_field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..rows import explode_structs
from . import extract as E
from .extract import ABSENT, PRESENT, candidate

# ---------------------------------------------------------------------------
# Document priorities, patterns, term lists, labels.
# ---------------------------------------------------------------------------
NOTE_PRIORITY = {"cppt_igd": 1, "resume": 2, "cppt_ranap": 3}
DIAGNOSIS_PRIORITY = {"resume": 1, "radiology": 2, "cppt_igd": 3, "cppt_ranap": 4}
LAB_PRIORITY = {"lab": 1, "resume": 2, "cppt_ranap": 3, "cppt_igd": 4}

AGE = r"(?i)(?:Umur|Usia)\s*[:=]?\s*(\d+)\s*(?:Tahun|th|thn)?"
GENDER = r"(?i)(?:JK|Jenis\s*Kelamin|Kelamin)\s*[:=]?\s*(L(?:aki[\s-]*laki)?|P(?:erempuan|ria)?)"
DIAGNOSIS = [
    (r"(?:diagnosis|diagnosa|assessment|asesmen|kesimpulan).{0,200}(?:stroke|infark|iskemik|hemoragik|ICH|PIS)", r".{0,200}"),
    (r"(stroke\s+infark|infark\s+cerebri|stroke\s+iskemik|stroke\s+non\s+hemoragik|SNH|cerebral\s+infarct)", r".{0,150}"),
    (r"(stroke\s+lakunar|lakunar\s+infark|infark\s+lakuner|small\s+vessel)", r".{0,150}"),
    (r"(stroke\s+hemoragik|ICH|PIS|perdarahan\s+intraserebral|perdarahan\s+intracerebral)", r".{0,150}"),
]
DIAGNOSIS_LEAD = 80
INFARCT_TERMS = ["infark", "infarct", "iskemik", "ischemic", "lakunar", "lacunar", "snh", "non hemoragik"]
BLEED_TERMS = ["hemoragik", "hemorrhagic", "ich", "pis", "perdarahan intraserebral", "perdarahan intracerebral"]
GCS_TOTAL = r"(?i)\bGCS\s*[:=]?\s*(1[0-5]|[3-9])\b"
GCS_PARTS = [
    r"(?i)\bGCS\s*[:=]?\s*E\s*(\d)\s*M\s*(\d)\s*V\s*(\d)\b",
    r"(?i)\bE\s*(\d)\s*M\s*(\d)\s*V\s*(\d)\b",
]
BLOOD_PRESSURE = r"(?i)\bTD\s*[:=]?\s*(\d{2,3})\s*/\s*(\d{2,3})\b"
SYSTOLIC, DIASTOLIC = (50, 300), (30, 200)
VITALS = {
    "hr": r"(?i)\b(?:HR|Nadi|Heart\s*Rate)\s*[:=]?\s*(\d{2,3})\b",
    "rr": r"(?i)\b(?:RR|Respiratory|Resp)\s*[:=]?\s*(\d{1,3})\b",
    "suhu": r"(?i)\b[SST]\s*[:=]?\s*(\d{2,3}(?:[.,]\d)?)\s*(?:[°′]?C)?\b",
    "spo2": r"(?i)\b(?:SPO2|SpO2|SaO2|O2\s*Sat)\s*[:=]?\s*(\d{2,3})\s*%?\b",
}
TEMPERATURE = r"(?i)\b[SST]\s*[:=]?\s*(\d{2,3}(?:[.,]\d)?)\s*(?:[°′]?\s*C)?\b"
TEMPERATURE_RANGE, FEVER_FROM = (35.0, 42.0), 38.0
FEVER_WORDS = r"\bfebris\b|demam|panas\s*badan|pireksia|suhu\s*tinggi"

CT_WORDS = r"(?:ct\s*scan|msct|ct\s*kepala|ct\s*head|head\s*ct)"
CT_SITES = [
    r"thalamus", r"talamus", r"kapsula\s*interna", r"capsula\s*interna", r"nukleus\s*lentiformis", r"ganglia\s*basalis",
    r"basal\s*ganglia", r"pons", r"cerebellum", r"serebelum", r"centrum\s*semiovale", r"corona\s*radiata", r"periventrikel",
    r"frontal", r"parietal", r"temporal", r"occipital", r"oksipital", r"subcortical", r"subkortikal", r"lacunar", r"lakunar",
    r"mca", r"aca", r"pca",
]
SITE_TERMS = ["infark", "infarct", "lakuner", "hipodens"]
ASPECTS = r"(?i)\bASPECTS\s*[:=]?\s*(\d{1,2})\b"
NO_BLEED = r"(?:tidak\s+tampak\s+(?:tanda[- ]tanda\s+)?perdarahan|no\s+hemorrhage|no\s+bleeding)"
BLEED = r"(?i)\b(?:perdarahan|hemorrhage|ICH|PIS|SAH|SAB|IVH|intraserebral|intracerebral|subarachnoid)"
SHIFT = r"(?:midline\s*shift|pergeseran\s*garis\s*tengah)"
NO_SHIFT = r"(?:tidak|no|tanpa).{0,30}midline"
HYDROCEPHALUS, ATROPHY = r"(?:hidrosefalus|hydrocephalus)", r"(?:atrofi|atrophy)"
CONCLUSIONS = [r"(?is)KESIMPULAN\s*[:=]?\s*(.{20,800})", r"(?is)IMPRESSION\s*[:=]?\s*(.{20,800})"]
DONE_DATE = r"(?i)TANGGAL\s*SELESAI\s*:\s*(\d{1,2}\s+\w+\s+\d{4})"
EXAM_DATE = r"(?i)Tgl\.?\s*Pmk\s*:\s*(\d{1,2}\s+\w+\s+\d{4})"
THORAX_WORDS = r"(?:foto\s*thorax|chest\s*x[- ]?ray|thorax\s*ap|thorax\s*pa|x\s*ray\s*thorax)"
THORAX_STRONG = r"(?:foto\s*thorax|chest\s*x[- ]?ray)"
CT_EXCLUDES = r"(?:ct\s*scan|msct|ct\s*kepala)"
IMPRESSION = r"(?is)KESAN\s*:\s*(.{10,600})"
CHEST_TERMS = [
    "broncho", "pneumonia", "cardiomegali", "paru", "jantung", "aorta", "infiltrat", "efusi", "pulmo", "cor", "trachea",
    "bronkitis", "atelektasis", "nodul", "massa",
]
LAB_DATES = [
    r"(?i)Tgl\.?\s*Sampling\s*:\s*(\d{1,2}\s+\w+\s+\d{4})",
    r"(?i)Tgl\.?\s*Selesai\s*:\s*(\d{1,2}\s+\w+\s+\d{4})",
    r"(?i)TANGGAL\s*SELESAI\s*:\s*(\d{1,2}\s+\w+\s+\d{4})",
]
EMERGENCY = r"(?i)(?:IGD|Instalasi\s*Gawat\s*Darurat|Gawat\s*Darurat|UGD|I\s*G\s*D)"
LAB_TESTS = {
    "lab_hb": [r"hemoglobin", r"hb\b"],
    "lab_leukosit": [r"leukosit", r"lekosit", r"wbc"],
    "lab_trombosit": [r"trombosit", r"platelet", r"plt\b"],
    "lab_gds": [r"glukosa\s*darah\s*sewaktu", r"gds\b", r"gula\s*darah", r"glucose"],
    "lab_ureum": [r"ureum", r"urea"],
    "lab_kreatinin": [r"kreatinin", r"creatinine", r"crea"],
    "lab_ht": [r"hematokrit", r"ht\b"],
    "lab_eritrosit": [r"eritrosit", r"rbc", r"red\s*blood"],
    "lab_natrium": [r"natrium", r"sodium"],
    "lab_kalium": [r"kalium", r"potassium"],
    "lab_asam_urat": [r"asam\s*urat", r"uric\s*acid"],
    "lab_inr": [r"\binr\b", r"inr\s*[\d]"],
    "lab_ldl": [r"ldl\b", r"ldl\s*kolesterol", r"low\s*density"],
    "lab_kolesterol_total": [r"kolesterol\s*total", r"total\s*kolesterol"],
    "lab_trigliserida": [r"trigliserida", r"trigliserid", r"triglyceride"],
    "lab_hba1c": [r"hba1c\b", r"hba1c", r"hb\s*a1c", r"hemoglobin\s*a1c", r"glycated\s*hemoglobin"],
}
RISKS = {
    "rf_hipertensi": r"(?i)(?:hipertensi|darah\s*tinggi|hypertension)",
    "rf_diabetes": r"(?i)(?:diabetes|dm\b|kencing\s*manis|gula\s*darah|diabetic)",
    "rf_dislipidemia": r"(?i)(?:dislipidemia|kolesterol\s*tinggi|hiperlipidemia|trigliserida)",
    "rf_jantung": r"(?i)(?:jantung|cardiovascular|penyakit\s*jantung|atherosclerosis|aterosklerosis|kardiovaskuler)",
    "rf_stroke_sebelumnya": r"(?i)(?:stroke\s*sebelumnya|riwayat\s*stroke|CVA\s*sebelumnya|stroke\s*old)",
    "rf_merokok": r"(?i)(?:merokok|rokok|perokok|smoker|smoking)",
    "rf_atrial_fibrilasi": r"(?i)(?:atrial\s*fibrilasi|atrial\s*fibrillation|\bAF\b|fibrilasi\s*atrial)",
    "rf_obesitas": r"(?i)(?:obesitas|obesity|obes|\bBMI\b|\bIMT\b|gemuk|overweight)",
}
PAST_HISTORY = r"(?is)(?:Riwayat\s*Penyakit\s*Dahulu|RPD)\s*[:=]?\s*(.{20,800})"
ACTIONS = {
    "act_konsul_neurologi": r"(?i)(?:konsul\s*(?:ke|neurologi|saraf|sp\.?\s*[ns])|neurologi|sp\.?\s*s)",
    "act_konsul_bedah_saraf": r"(?i)(?:konsul\s*(?:bedah\s*saraf|neurosurgeri|sp\.?\s*bs))",
    "act_konsul_jantung": r"(?i)(?:konsul\s*(?:jantung|kardio|kardiologi|sp\.?\s*jp))",
    "act_rawat_icu_hcu": r"(?i)(?:rawat\s*(?:icu|hcu|picu|nicu|intensive\s*care|high\s*care))",
    "act_fisioterapi": r"(?i)(?:fisioterapi|fisio\s*terapi|fisioterapis|ftr|physiotherapy)",
    "act_konsul_gizi": r"(?i)(?:konsul\s*(?:gizi|nutrisi|nutrisionis|dietisien)|ahli\s*gizi)",
    "act_skrining_menelan": r"(?i)(?:skrining\s*menelan|skrining\s*telan|swallowing\s*screening|tes\s*menelan)",
    "act_edukasi_keluarga": r"(?i)(?:edukasi|penyuluhan|konseling|health\s*education|inform\s*consent|keluarga)",
}
WAY_OUT = r"(?i)(?:Cara\s*Pasien\s*Keluar|Cara\s*Keluar)\s*[:=]?\s*([A-Za-z\s]{5,50})"
WAY_CLASSES = [
    ("meninggal_dunia", ["meninggal", "meninggal dunia", "death"]),
    ("dirujuk", ["rujuk", "dirujuk", "rujukan"]),
    ("pulang_ke_rumah", ["pulang", "ke rumah", "perbaikan", "baik", "stabil"]),
    ("aps", ["aps", "atas permintaan", "paksa"]),
]
CONDITION = r"(?i)(?:Kondisi\s*Pasien\s*(?:Pada\s*Saat)?\s*Pulang|Kondisi\s*Pulang)\s*[:=]?\s*([A-Za-z\s]{5,50})"
CONDITION_CLASSES = [
    ("perbaikan", "perbaikan"), ("membaik", "perbaikan"), ("baik", "perbaikan"), ("stabil", "stabil"), ("stabilis", "stabil"),
    ("memburuk", "perburukan"), ("perburukan", "perburukan"), ("buruk", "perburukan"), ("meninggal", "meninggal_dunia"),
    ("meninggal dunia", "meninggal_dunia"), ("death", "meninggal_dunia"), ("deceased", "meninggal_dunia"), ("pulang", "pulang"),
    ("rawat jalan", "rawat_jalan"),
]
CONTROL_DATE = r"(?i)(?:Intruksi\s*Tindak\s*Lanjut\s*Kontrol|Rencana\s*Kontrol|Kontrol)\s*[:=]?\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
STATED_STAY = r"(?i)(?:Lama\s*Rawat|Lama\s*Dirawat|LOS|Length\s*Of\s*Stay)\s*[:=]?\s*(\d+)\s*(?:hari|hr|h)?"
DATE_IN = r"(?i)(?:Tanggal\s*Masuk|Tgl\s*Masuk|MRS|Admission)\s*[:=]?\s*(\d{1,2}\s+\w+\s+\d{4})"
DATE_OUT = r"(?i)(?:Tanggal\s*Keluar|Tgl\s*Keluar|Keluar)\s*[:=]?\s*(\d{1,2}\s+\w+\s+\d{4})"
NIHSS = r"(?i)\bNIHSS\s*(?:score|skor)?\s*[:=]?\s*(\d{1,2})\b"
NIHSS_RANGE = (0, 42)
ONSET = [
    r"(?i)(?:onset|mulai\s*keluhan|awitan)\s*[:\-]?\s*([^\n]{0,120})",
    r"(?i)(?:keluhan\s*sejak)\s*([^\n]{0,120})",
    r"(?i)(?:last\s*known\s*well|LKW)\s*[:\-]?\s*([^\n]{0,120})",
]
DRUG_FLAGS = {
    "med_aspirin": r"(?i)\b(?:aspirin|aspilet|asetosal)\b",
    "med_clopidogrel": r"(?i)\b(?:clopidogrel|cpg)\b",
    "med_statin": r"(?i)\b(?:atorvastatin|simvastatin|rosuvastatin)\b",
    "med_citicoline": r"(?i)\b(?:citicoline|citicolin|sitikolin)\b",
}
GIVEN, NOT_RECORDED = "diberikan", "tidak_tercatat"

PATIENT, FILE, TYPE, TEXT = "patient_id", "source_file", "doc_type", "text"


# ---------------------------------------------------------------------------
# Shared steps
# ---------------------------------------------------------------------------
def _group(text: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _first_of(text: Column, patterns: list[str], i: int = 1) -> Column:
    return F.coalesce(*[_group(text, p, i) for p in patterns])


@dataclass(frozen=True)
class Found:
    """A candidate of a document: its value, and where it ranks."""

    name: str
    value: Column
    prio: Column | int = 0
    pos: Column | int = 0
    by_file: bool = True
    types: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Extractor:
    """What one built-in looks for: candidates, the types it reads, the fields in
    which the last file wins, defaults, and fields derived from a winner."""

    found: Callable[[], list[Found]]
    types: tuple[str, ...] | None = None
    last: tuple[str, ...] = ()
    defaults: dict[str, str] = dc_field(default_factory=dict)
    derive: dict[str, Callable[[Column], dict[str, Column]]] = dc_field(default_factory=dict)

    def __call__(self, docs: DataFrame) -> DataFrame:
        return run_extractors(docs, [self])


def tagged(extractor: Extractor, tag: str) -> Extractor:
    """The extractor with ``tag`` behind all its field names."""

    def derived(fn: Callable[[Column], dict[str, Column]]) -> Callable[[Column], dict[str, Column]]:
        return lambda v: {n + tag: c for n, c in fn(v).items()}

    return Extractor(
        lambda: [replace(f, name=f.name + tag) for f in extractor.found()],
        extractor.types,
        tuple(n + tag for n in extractor.last),
        {k + tag: v for k, v in extractor.defaults.items()},
        {k + tag: derived(fn) for k, fn in extractor.derive.items()},
    )


def _flag(test: Column, name: str, value: str = PRESENT) -> Found:
    return Found(name, F.when(test, F.lit(value)), by_file=False)


def _priority(table: dict[str, int]) -> Column:
    return reduce(lambda rest, kv: F.when(F.col(TYPE) == kv[0], F.lit(kv[1])).otherwise(rest), table.items(), F.lit(9))


def run_extractors(docs: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """Long ``(patient, field, value)`` of any number of extractors: one scan of
    the documents and one aggregation over their candidates.

    Per (patient, field) the smallest (prio, pos, file) wins; in ``last`` fields
    the largest, unless all its candidates rank 0 and a field may rank higher."""
    found, last, defaults, derive = [], set(), {}, {}
    for e in extractors:
        found += [(f, f.types or e.types) for f in e.found()]
        last |= set(e.last)
        defaults.update(e.defaults)
        derive.update(e.derive)

    def typed(value: Column, types: tuple[str, ...] | None) -> Column:
        return value if types is None else F.when(F.col(TYPE).isin(*types), value)

    def number(x: Column | int) -> Column:
        return F.lit(x) if isinstance(x, int) else x

    # values first, as plain columns: each regular expression runs once, in codegen
    staged = docs.select(PATIENT, FILE, TYPE, TEXT, *[typed(f.value, types).alias(f"__v{i}") for i, (f, types) in enumerate(found)])
    items = [
        F.when(
            F.col(f"__v{i}").isNotNull(),
            candidate(f.name, number(f.prio), number(f.pos), F.col(FILE) if f.by_file else F.lit(""), F.col(f"__v{i}")),
        )
        for i, (f, _) in enumerate(found)
    ]
    rows = explode_structs(staged, [PATIENT], F.array_compact(F.array(*items)))
    key = F.struct("prio", "pos", "ord", "value")
    picked = rows.groupBy(PATIENT, "field").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    ranked = sorted({f.name for f, _ in found if isinstance(f.prio, int) and f.prio > 0} & last)
    value = F.col("lo.value")
    if last:
        value = F.when(F.col("field").isin(*sorted(last)), F.col("hi.value")).otherwise(value)
    if ranked:
        value = F.when(F.col("field").isin(*ranked) & (F.col("hi.prio") == 0), F.col("lo.value")).otherwise(value)
    out = picked.select(PATIENT, "field", value.alias("value"))
    if derive:
        own = F.array(F.struct(F.col("field").alias("field"), F.col("value").alias("value")))
        pairs = reduce(
            lambda rest, kv: F.when(
                F.col("field") == kv[0],
                F.array(*[F.struct(F.lit(n).alias("field"), v.cast("string").alias("value")) for n, v in kv[1](F.col("value")).items()]),
            ).otherwise(rest),
            derive.items(),
            own,
        )
        out = explode_structs(out, [PATIENT], pairs).filter(F.col("value").isNotNull())
    return with_defaults(docs, out, defaults) if defaults else out


def with_defaults(docs: DataFrame, found: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Every patient gets the fields that have a default; the others stay as
    found.  The spine reads only the patient column."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(d).alias("value")) for f, d in defaults.items()])
    spine = explode_structs(docs.select(PATIENT).distinct(), [PATIENT], rows)
    return (
        spine.withColumn("rank", F.lit(1)).unionByName(found.withColumn("rank", F.lit(0)))
        .groupBy(PATIENT, "field").agg(F.min_by("value", "rank").alias("value"))
    )


# ---------------------------------------------------------------------------
# Extractors
# ---------------------------------------------------------------------------
def demographics(docs: DataFrame) -> DataFrame:
    """Last age and gender up to the first file by which both are known."""
    t = F.col(TEXT)
    g = F.upper(_group(t, GENDER))
    gender = F.when(g.startswith("L"), "Laki-laki").when(g.isNotNull(), "Perempuan")
    hits = docs.select(PATIENT, FILE, _group(t, AGE).alias("age"), gender.alias("gender")).filter(
        F.col("age").isNotNull() | F.col("gender").isNotNull()
    )
    complete = hits.groupBy(PATIENT).agg(
        F.min(F.when(F.col("age").isNotNull(), F.col(FILE))).alias("a"), F.min(F.when(F.col("gender").isNotNull(), F.col(FILE))).alias("g")
    ).select(PATIENT, F.when(F.col("a").isNotNull() & F.col("g").isNotNull(), F.greatest("a", "g")).alias("stop"))
    read = hits.join(complete, PATIENT).filter(F.col("stop").isNull() | (F.col(FILE) <= F.col("stop")))
    return read.select(
        PATIENT, FILE, F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in ("age", "gender")])).alias("r")
    ).select(PATIENT, FILE, "r.*").filter(F.col("value").isNotNull()).groupBy(PATIENT, "field").agg(
        F.max_by("value", FILE).alias("value")
    )


def _stroke_type(evidence: Column) -> Column:
    low = F.lower(evidence)
    infarct, bleed = T.any_contains(low, INFARCT_TERMS), T.any_contains(low, BLEED_TERMS)
    return F.when(infarct & bleed, "MIXED").when(infarct, "INFARK").when(bleed, "HEMORAGIK").otherwise("UNCLEAR")


def _diagnosis() -> list[Found]:
    """The evidence starts up to 80 characters before a mention.  The mention is
    searched first and the lead is cut out around it: a pattern that begins with
    the lead would be tried 80 times at every letter of the text."""
    t = F.col(TEXT)
    found = []
    for core, tail in DIAGNOSIS:
        at = F.regexp_instr(t, F.lit(f"(?is){core}"))
        start = F.greatest(at - DIAGNOSIS_LEAD, F.lit(1))
        window = F.substring(t, start, F.lit(1000))
        evidence = F.when(at > 0, T.clean_snippet(F.regexp_extract(window, f"(?is)^.{{0,{DIAGNOSIS_LEAD}}}{core}{tail}", 0), 450))
        found.append(Found("diagnosis_text", evidence, _priority(DIAGNOSIS_PRIORITY), start))
    return found


def _gcs() -> list[Found]:
    t = F.col(TEXT)
    found = [Found("gcs", _group(t, GCS_TOTAL), _priority(NOTE_PRIORITY), F.regexp_instr(t, F.lit(GCS_TOTAL)))]
    for p in GCS_PARTS:
        total = reduce(lambda a, b: a + b, [F.regexp_extract(t, p, i).try_cast("int") for i in (1, 2, 3)])
        found.append(Found("gcs", total.cast("string"), _priority(NOTE_PRIORITY), F.regexp_instr(t, F.lit(p))))
    return found


def _vitals() -> list[Found]:
    """First file with a plausible value, per sign."""
    t = F.col(TEXT)
    pairs = F.arrays_zip(
        F.regexp_extract_all(t, F.lit(BLOOD_PRESSURE), F.lit(1)).alias("s"), F.regexp_extract_all(t, F.lit(BLOOD_PRESSURE), F.lit(2)).alias("d")
    )
    good = F.try_element_at(
        F.filter(pairs, lambda p: p["s"].cast("int").between(*SYSTOLIC) & p["d"].cast("int").between(*DIASTOLIC)), F.lit(1)
    )
    signs = [Found(name, F.replace(_group(t, p), F.lit(","), F.lit("."))) for name, p in VITALS.items()]
    return [Found("td_sistol", good["s"]), Found("td_diastol", good["d"]), *signs]


def _ct_scan() -> list[Found]:
    t, low = F.col(TEXT), F.lower(TEXT)
    sites = []
    for s in CT_SITES:
        around = F.regexp_extract(low, r"(?d).{0,40}" + s + r".{0,60}", 0)
        sites.append(F.when(low.rlike(s), F.when(T.any_contains(around, SITE_TERMS), F.lit(s.replace(r"\s*", " ")))))
    listed = F.array_join(F.array_sort(F.array_compact(F.array(*sites))), ", ")
    located = F.when(T.any_contains(low, SITE_TERMS), F.nullif(listed, F.lit("")))
    bleeding = F.when(low.rlike(NO_BLEED), "tidak_ada").when(low.rlike(BLEED), "ada")
    shift = F.when(low.rlike(SHIFT), F.when(low.rlike(NO_SHIFT), "tidak_ada").otherwise("ada"))
    return [
        _flag(low.rlike(CT_WORDS), "ct_documented"),
        Found("ct_infark_lokasi", located),
        Found("ct_aspects", _group(t, ASPECTS)),
        Found("ct_perdarahan", bleeding),
        Found("ct_midline_shift", shift),
        _flag(low.rlike(HYDROCEPHALUS), "ct_hidrosefalus"),
        _flag(low.rlike(ATROPHY), "ct_atrofi"),
        Found("ct_result", T.clean_snippet(_first_of(t, CONCLUSIONS), 600)),
        Found("ct_tanggal", T.parse_date_text(_group(t, DONE_DATE))),
    ]


def _thorax() -> list[Found]:
    t, low = F.col(TEXT), F.lower(TEXT)
    impression = _group(t, IMPRESSION)
    chest = impression.isNotNull() & T.any_contains(F.lower(impression), CHEST_TERMS)
    documented = (low.rlike(THORAX_WORDS) & ~low.rlike(CT_EXCLUDES)) | low.rlike(THORAX_STRONG) | chest
    return [
        _flag(documented, "thorax_documented"),
        Found("thorax_kesan", F.when(chest, T.clean_snippet(impression, 400))),
        # the last completion date wins over the first examination date
        Found("thorax_tanggal", T.parse_date_text(_group(t, DONE_DATE)), prio=1),
        Found("thorax_tanggal", T.parse_date_text(_group(t, EXAM_DATE))),
    ]


def _lab_dates() -> list[Found]:
    t = F.col(TEXT)
    day = F.coalesce(*[T.parse_date_text(_group(t, p)) for p in LAB_DATES])
    urgent = F.lower(FILE).contains("igd") | t.rlike(EMERGENCY)
    return [
        Found("lab_tanggal_igd", F.when(urgent, day)),
        Found("lab_tanggal_ranap", F.when(~urgent, day)),
        Found("lab_tanggal_pertama", day, by_file=False),
    ]


def _fever() -> list[Found]:
    t, low = F.col(TEXT), F.lower(TEXT)
    numbers = F.transform(
        F.regexp_extract_all(t, F.lit(TEMPERATURE), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")
    )
    top = F.array_max(F.filter(numbers, lambda x: x.between(*TEMPERATURE_RANGE)))
    spoken = low.rlike(FEVER_WORDS)
    return [
        _flag(spoken | (top >= FEVER_FROM), "demam_selama_rawat"),
        _flag(spoken & (F.col(TYPE) == "cppt_igd"), "demam_saat_masuk"),
        Found("suhu_tertinggi", F.when(top.isNotNull(), F.format_string("%.1f", top)), pos=(-top * 10).cast("int"), by_file=False),
    ]


def _lab_value(text: Column, names: list[str]) -> Column:
    values = [_group(text, r"(?im)" + n + r"[\s\S]*?([\d.,]+)") for n in names]
    return F.replace(F.coalesce(*values), F.lit(","), F.lit("."))


def _lab_values(prio: Column | int = 0) -> list[Found]:
    """First file with a hit; within it the first name pattern."""
    return [Found(f, _lab_value(F.col(TEXT), names), prio) for f, names in LAB_TESTS.items()]


def _flags(patterns: dict[str, str], value: str = PRESENT) -> list[Found]:
    return [_flag(F.col(TEXT).rlike(p), name, value) for name, p in patterns.items()]


def _risk_factors() -> list[Found]:
    history = T.clean_snippet(_group(F.col(TEXT), PAST_HISTORY), 400)
    return [*_flags(RISKS), Found("rpd_text", history, types=("resume",))]


def _first_match(raw: Column, classes: list[tuple[str, str]]) -> Column:
    return reduce(lambda rest, kv: F.when(raw.contains(kv[0]), kv[1]).otherwise(rest), reversed(classes), F.lit(None))


OUTCOME_FIELDS = ["cara_keluar", "keterangan_pulang", "kondisi_pulang", "rencana_kontrol", "lama_rawat_hari"]


def _outcome() -> list[Found]:
    """Discharge facts of a patient's first resume - only the first counts, also
    where it lacks a field, so its facts travel as one value."""
    t = F.col(TEXT)
    way = T.strip(_group(t, WAY_OUT))
    low_way = F.lower(way)
    way_class = reduce(
        lambda rest, kv: F.when(T.any_contains(low_way, kv[1]), kv[0]).otherwise(rest), reversed(WAY_CLASSES), F.lit(None)
    )
    raw = F.lower(T.strip(_group(t, CONDITION)))
    condition = F.coalesce(
        _first_match(raw, CONDITION_CLASSES), F.concat(F.upper(F.substring(raw, 1, 1)), F.substring(raw, F.lit(2), F.length(raw)))
    )
    d_in, d_out = (F.try_to_date(T.parse_date_text(_group(t, p)), "yyyy-MM-dd") for p in (DATE_IN, DATE_OUT))
    days = F.datediff(d_out, d_in)
    stay = F.coalesce(_group(t, STATED_STAY), F.when(days >= 0, days.cast("string")))
    values = [way, way_class, condition, _group(t, CONTROL_DATE), stay]
    return [Found("__outcome", F.to_json(F.struct(*[v.cast("string").alias(n) for n, v in zip(OUTCOME_FIELDS, values)])))]


def _nihss() -> list[Found]:
    t = F.col(TEXT)
    score = _group(t, NIHSS)
    ok = F.when(score.cast("int").between(*NIHSS_RANGE), score)
    return [Found("nihss", ok, _priority(NOTE_PRIORITY), F.regexp_instr(t, F.lit(NIHSS)))]


def _onset() -> list[Found]:
    t = F.col(TEXT)
    return [Found("onset", T.clean_snippet(_group(t, p), 450), _priority(NOTE_PRIORITY), F.regexp_instr(t, F.lit(p))) for p in ONSET]


NOTES = tuple(NOTE_PRIORITY)
diagnosis = Extractor(_diagnosis, derive={"diagnosis_text": lambda v: {"diagnosis_text": v, "stroke_type": _stroke_type(v)}})
gcs = Extractor(_gcs, NOTES)
vitals = Extractor(_vitals, NOTES)
ct_scan = Extractor(
    _ct_scan, ("radiology", "resume"),
    ("ct_infark_lokasi", "ct_aspects", "ct_perdarahan", "ct_midline_shift", "ct_result", "ct_tanggal"), {"ct_documented": ABSENT},
)
thorax = Extractor(_thorax, ("radiology", "resume"), ("thorax_kesan", "thorax_tanggal"), {"thorax_documented": ABSENT})
lab_dates = Extractor(_lab_dates, ("lab",), ("lab_tanggal_igd",))
fever = Extractor(_fever, ("cppt_igd", "cppt_ranap"), defaults={"demam_saat_masuk": ABSENT, "demam_selama_rawat": ABSENT})
lab_values = Extractor(_lab_values, ("lab",))
lab_values_by_priority = Extractor(lambda: _lab_values(_priority(LAB_PRIORITY)), tuple(LAB_PRIORITY))
risk_factors = Extractor(_risk_factors, defaults={n: ABSENT for n in RISKS})
actions = Extractor(lambda: _flags(ACTIONS), defaults={n: ABSENT for n in ACTIONS})
drug_flags = Extractor(lambda: _flags(DRUG_FLAGS, GIVEN), defaults={n: NOT_RECORDED for n in DRUG_FLAGS})
outcome = Extractor(
    _outcome, ("resume",), derive={"__outcome": lambda v: {n: F.get_json_object(v, f"$.{n}") for n in OUTCOME_FIELDS}}
)
nihss = Extractor(
    _nihss, NOTES, defaults={"nihss_documented": "no"}, derive={"nihss": lambda v: {"nihss": v, "nihss_documented": F.when(v.isNotNull(), "yes")}}
)
onset_text = Extractor(_onset, NOTES)


def medication_fields(docs: DataFrame, drugs: dict[str, list[str]]) -> DataFrame:
    found = E.medications(docs, drugs, PATIENT, FILE, TEXT)
    parts = [("value", ""), ("detail", "_detail"), ("dose", "_dosis"), ("duration", "_durasi")]
    rows = F.array(*[F.struct(F.concat("drug_key", F.lit(s)).alias("field"), F.col(c).alias("value")) for c, s in parts])
    return explode_structs(found, [PATIENT], rows)


#: Names as rule files use them.  ``demographics`` and ``medications`` reduce in
#: their own way; all others can share one scan (:func:`run_extractors`).
BUILTINS = {
    "demographics": demographics,
    "diagnosis": diagnosis,
    "gcs": gcs,
    "vitals": vitals,
    "ct_scan": ct_scan,
    "thorax": thorax,
    "lab_dates": lab_dates,
    "lab_values": lab_values,
    "demam": fever,
    "medications": medication_fields,
    "risk_factors": risk_factors,
    "actions": actions,
    "outcome": outcome,
}


def regex_extractor(rules: list[E.FieldRule]) -> Extractor:
    """Regex fields as an extractor; '' stands for a match without a value."""

    def found() -> list[Found]:
        t = F.col(TEXT)
        out = []
        for r in rules:
            prio = E.type_priority(F.col(TYPE), r.doc_types)
            hit = T.clean_snippet(F.regexp_extract(t, r.java, 1), 500) if r.has_group else F.lit(PRESENT)
            out.append(Found(r.field, F.when(prio.isNotNull() & t.rlike(r.java), hit), prio))
        return out

    return Extractor(found)
