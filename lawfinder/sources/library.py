"""The library of reference equations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

SCHEMA = (
    "cluster string, subfield string, latex string, equation_name string, equation_name_raw string, image_hint string, unit string, "
    "operators array<string>, functions array<string>"
)
SEARCH_FIELDS = ["equation_name", "equation_name_raw", "image_hint", "unit", "subfield", "latex", "operators", "functions"]
DIAGNOSE_FIELDS = ["equation_name", "equation_name_raw", "image_hint", "subfield", "latex"]

# Textbook relations as (cluster, subfield, name, LaTeX, image hint), with some hard to read on purpose.
TEXTBOOK = (
    ("0", "Mechanics", "Hooke's Law", r"F = k x", None), ("0", "Kinematics", "Uniform Acceleration", r"v = v_0 + a t", None),
    ("0", "Thermal", "Linear Expansion", r"L = L_0 + \alpha L_0 T", None), ("1", "Strengthening", "Hall-Petch Relation", r"\sigma_y = \sigma_0 + k_y d^{-1/2}", None),
    ("1", "Gravitation", "Newton's Gravitation", r"F = G \frac{m_1 m_2}{r^2}", None), ("1", "Electricity", "Coulomb's Law", r"F = \frac{k q_1 q_2}{r^2}", None),
    ("2", "Fracture", "Griffith Criterion", r"\sigma_f = \sqrt{\frac{2 E \gamma}{\pi a}}", None), ("2", "Plasticity", "Taylor Hardening", r"\tau = \tau_0 + \alpha G b \sqrt{\rho}", None),
    ("3", "Kinetics", "Arrhenius Equation", r"k = A \exp(-\frac{E}{R T})", None), ("3", "Statistics", "Planck Distribution", r"n = \frac{1}{\exp(h \nu / (k T)) - 1}", None),
    ("4", "Diffusion", "Diffusion Length", r"x = \sqrt{D t}", None), ("4", "Kinetics", "Avrami-Type Growth", r"r = \sqrt{1 - \exp(-k t)}", None),
    ("5", "Creep", "Norton Creep", r"\dot{\epsilon} = A \sigma^{n} \exp(-Q/(R T))", None), ("5", "Plasticity", "Hollomon Hardening", r"\sigma = K \epsilon^{n}", None),
    ("6", "Relativity", "Lorentz Factor", r"\gamma = \frac{1}{\sqrt{1 - v^2/c^2}}", None), ("6", "Optics", "Snell Angle", r"n = \frac{\sin(a)}{\sin(b)}", None),
    ("7", "Electrochemistry", "Nernst Equation", r"E = E_0 - \frac{R T}{n F} \ln(Q)", None), ("7", "Chemistry", "pH Definition", r"pH = -\log(a)", None),
    ("7", "Thermodynamics", "Boltzmann Entropy", r"S = k \ln(W)", None), ("8", "Kinetics", "Radioactive Decay", r"N = N_0 \exp(-\lambda t)", None),
    ("8", "Optics", "Beer-Lambert Law", r"I = I_0 e^{-a x}", None), ("9", "Waves", "Harmonic Motion", r"x = A \sin(\omega t) + c", None),
    ("9", "Waves", "Pendulum Period", r"T = 2 \pi \sqrt{\frac{L}{g}}", None), ("10", "Crystallography", "Schmid Law", r"\tau = \sigma \cos(\phi) \cos(\lambda)", None),
    ("10", "Waves", "Beat", r"y = \sin(a t) \cos(b t)", None), ("11", "Magnetism", "Langevin Function", r"L = \frac{\cosh(x)}{\sinh(x)} - \frac{1}{x}", None),
    ("11", "Fluids", "Poiseuille Flow", r"Q = \frac{\pi p r^4}{8 \mu L}", None), ("12", "Mechanics", "Friction Angle", r"\mu = \tan(\theta)", None),
    ("12", "Optics", "Brewster Angle", r"\tan(b) = \sqrt{\frac{e_2}{e_1}}", None), ("1", "Strengthening", "Hall-Petch Relation", r"H = H_0 + k_h d^{-1/2}", None),
    ("0", "Thermal", None, r"q = -k \vphantom{x} \frac{T}{x}", "heat conduction sheet"), ("6", "Thermal", None, "λ*T ≈ b", "displacement note"), ("2", "Mechanics", "Untitled", "", None),
)


def textbook(spark: SparkSession) -> DataFrame:
    rows = [(c, s, x, n, n, h, None, [], []) for c, s, n, x, h in TEXTBOOK]
    return positioned(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", position long"))


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records in file order; a missing file is an empty library."""
    try:
        rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return positioned(rows.withColumn("position", F.monotonically_increasing_id()))


def positioned(rows: DataFrame) -> DataFrame:
    """Records with their signature, the quality of its text, and a display name."""
    signed = rows.withColumn("lib_sig", text.signature(F.coalesce("latex", F.lit("")), F.col("operators"), F.col("functions")))
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    return signed.withColumn("quality", text.parse_quality(F.col("lib_sig.norm"))).withColumn("display_name", F.coalesce(filled("equation_name"), filled("image_hint"), F.lit("Unknown")))


def clusters(library: DataFrame) -> DataFrame:
    """Per cluster its size, three most frequent subfields and first three formulas."""
    from ..operators.catalog import profile

    return profile(library, "cluster", "subfield", "latex", "position")


def subfields(library: DataFrame) -> DataFrame:
    return library.select("subfield").distinct().orderBy("subfield")


def with_labels(library: DataFrame) -> DataFrame:
    from ..operators.catalog import labelled

    return labelled(library, F.format_string("[C%s]  %s  (%s)", "cluster", "display_name", "subfield"), ["position"])


def diagnosed(library: DataFrame, keyword: str, most: int = 5) -> DataFrame:
    """How the first records that match a keyword were read, and how many match in all."""
    from ..functions.transforms import quality_label
    from ..operators.catalog import searched

    hits = searched(library, keyword, DIAGNOSE_FIELDS)
    total = hits.agg(F.count(F.lit(1)).alias("matches"))  # one row
    return hits.orderBy("position").limit(most).join(F.broadcast(total)).orderBy("position").select(
        "display_name", "cluster", "subfield", "latex", F.col("lib_sig.norm").alias("normalized"), "quality", quality_label(F.col("quality")).alias("quality_label"),
        "lib_sig.operators", "lib_sig.functions", "lib_sig.var_names", "lib_sig.term_shapes", "matches",
    )
