"""Defaults and fixed values.

Everything in the FIXED VALUES block must equal the values the analysed
multi-label pipeline uses, otherwise results differ. Everything else is a
tunable of this library.
"""

from __future__ import annotations

import numpy as np

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the analysed pipeline for identical results)
# ---------------------------------------------------------------------------
SEED = 1206
NUMERIC_TYPES = ("int", "bigint", "float", "double")  # Int32, Int64, Float32, Float64
TEST_SIZE = 0.2  # train / rest
VAL_SPLIT = 0.5  # val / test of the rest
TINY_SIZE = 1000
POS_WEIGHT_EPS = 1e-6
CB_BETA = 0.9999
CB_EPS = 1e-4
FOCAL_GAMMA = 2.0
ASL_GAMMA_NEG = 4.0
ASL_GAMMA_POS = 1.0
ASL_CLIP = 0.01
PATIENCE = 5
TRAIN_BATCH_SIZE = 2048
EMBED_BATCH_SIZE = 64
EMBED_DIM_TEXT = 768
GATE_NEAR_ZERO_BATCH, GATE_NEAR_ONE_BATCH = 0.05, 0.95
GATE_NEAR_ZERO_REPORT, GATE_NEAR_ONE_REPORT = 0.1, 0.9
GATE_NEUTRAL_LO, GATE_NEUTRAL_HI = 0.4, 0.6
GATE_HIST_BINS = 50
GATE_HEATMAP_ROWS, GATE_HEATMAP_MIN_ROWS = 100, 10
SIMPLEX_XATOL, SIMPLEX_FATOL = 0.01, 1e-4
SIMPLEX_BOUNDS = (0.05, 0.95)
PARITY_TOL = 1e-4
CROSS_TYPES = ["standard", "gated"]
DEEP_TYPES = ["bottleneck", "moe"]
# Grid candidates are generated exactly as the analysed code does (np.arange), so the
# float noise of each element (0.15000000000000002, ...) is preserved.
GRID_CANDIDATES = [float(x) for x in np.arange(0.05, 0.95, 0.05)]  # 18 values
COARSE_CANDIDATES = [float(x) for x in np.arange(0.1, 0.9, 0.1)]  # 8 values
# ---------------------------------------------------------------------------

# Library tunables (not fixed by the analysed code)
SPLIT_BUCKET_HEX = 4  # prefix-sum buckets = 16**4 per part
CUT_BUCKET_HEX = 3  # hash buckets per stratum that the split's cut points are looked up in
SCORE_BUCKETS = 1 << 16  # prefix-sum buckets for scores in [0, 1]
MAX_CLASSES = 100_000  # widest one-hot / most strata that are broadcast; more raise an error
EXCHANGE_TRIES = 64  # label-sets tried against all others for an exchange when label shares are balanced
BALANCE_KICKS = 200  # steps away from a state that no change improves, where a label is off by more than one row
CHART_BUCKETS = 100  # parts of the x axis of a bounded chart, at most four points each
