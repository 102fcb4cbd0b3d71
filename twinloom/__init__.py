"""Profiling, noisy synthesis and fidelity evaluation of related tables on Spark."""

from twinloom.functions.hashing import Draws
from twinloom.functions.naming import KeyNames
from twinloom.operators.marginals import Domain
from twinloom.plans.discover import Discovery, discover
from twinloom.plans.evaluate import evaluate
from twinloom.plans.sweep import allocate, epsilon_sweep, run_pipeline
from twinloom.plans.synthesize import Synthesis, synthesize
from twinloom.sources.tables import (
    load_tables,
    preview,
    publish_tables,
    published_tables,
    save_tables,
    write_csv_bundle,
)

__all__ = [
    "Discovery",
    "Domain",
    "Draws",
    "KeyNames",
    "Synthesis",
    "allocate",
    "discover",
    "epsilon_sweep",
    "evaluate",
    "load_tables",
    "preview",
    "publish_tables",
    "published_tables",
    "run_pipeline",
    "save_tables",
    "synthesize",
    "write_csv_bundle",
]
