"""Token files: rules are opened without an array for each, and the fullest slots are found without ordering all."""

from __future__ import annotations

import numpy as np

from tallyloom.llm import token_files as t


def test_rules_are_opened_together(monkeypatch):
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.tile(rng.integers(0, 50, 40), 300), rng.integers(0, 50, 60_000)])
    symbols, rules = t.repair(ids, 1000)
    made, ordered = [], []
    whole = np.concatenate
    monkeypatch.setattr(t.np, "concatenate", lambda *a, **k: made.append(1) or whole(*a, **k))
    assert (t.expand(symbols, rules, 1000) == ids).all()
    assert len(rules) > 100 and len(made) <= 2
    part = np.partition
    monkeypatch.setattr(t.np, "partition", lambda x, k: ordered.append(len(x)) or part(x, k))
    many = rng.integers(0, 3000, t.FEW * 2)
    again = t.repair(many, 5000)
    assert (t.expand(*again, 5000) == many).all()
    assert t.SLOTS not in ordered
