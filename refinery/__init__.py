"""Reproducible cleaning of tables on Spark; ``refinery.llm`` has operators for text corpora.

The names below are the library's surface. They are imported when first used.
"""

from importlib import import_module

__version__ = "0.2.0"

_WHERE = {
    "build": "session",
    "load": "sources.readers",
    "save_clean": "sources.writers",
    "export_dataset": "sources.writers",
    "sample": "sources.sample",
    "profile": "operators.profile",
    "summary_card": "operators.profile",
    "Profile": "operators.profile",
    "Numbers": "operators.profile",
    "resolve_formats": "operators.format",
    "classify": "operators.missing",
    "recommend": "operators.missing",
    "fit_fences": "operators.outliers",
    "bin_column": "operators.features",
    "scale_column": "operators.features",
    "frequency_encode": "operators.features",
    "datetime_decompose": "operators.features",
    "ingest": "operators.intake",
    "staged": "operators.intake",
    "Card": "plans.cards",
    "Kind": "plans.cards",
    "Log": "plans.cards",
    "Pattern": "plans.cards",
    "Stage": "plans.cards",
    "Status": "plans.cards",
    "Thresholds": "plans.cards",
    "Hooks": "plans.hooks",
    "Session": "plans.interactive",
    "Store": "plans.interactive",
    "State": "plans.pipeline",
    "StageRows": "plans.pipeline",
    "run_pipeline": "plans.pipeline",
    "write_all": "plans.pipeline",
    "Plan": "plans.plan",
    "replay": "plans.plan",
    "script": "plans.plan",
    "verify": "plans.plan",
    "flow_svg": "plans.report",
    "markdown": "plans.report",
}
#: Names that mean the same function of several stages, under the stage's name.
_OF_STAGE = {
    f"{what}_{stage}": (module, what)
    for stage, module in (("duplicates", "operators.duplicates"), ("missing", "operators.missing"), ("outliers", "operators.outliers"))
    for what in ("detect", "apply")
}
__all__ = ["__version__", *_WHERE, *_OF_STAGE]


def __getattr__(name: str):
    module, what = _OF_STAGE.get(name) or (_WHERE.get(name), name)
    if module is None:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{module}"), what)


def __dir__() -> list[str]:
    return sorted(__all__)
