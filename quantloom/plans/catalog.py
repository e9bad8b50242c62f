"""Import every module that registers queries."""
from __future__ import annotations

import importlib

MODULES = ["q_technical", "q_basics", "q_risk", "q_state_fund", "q_sentiment", "q_backtest", "q_factors", "q_kernels", "q_network", "q_streaming", "q_learning"]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"quantloom.plans.{m}")
