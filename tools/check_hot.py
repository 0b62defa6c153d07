"""Run check_oracle with tiny group limits, so that many groups take the hot way."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankfold.operators import grouping  # noqa: E402

grouping.MAX_GROUP_ROWS = 5
grouping.SMALL_INPUT_BYTES = 0

import check_oracle  # noqa: E402

if __name__ == "__main__":
    sys.exit(check_oracle.main())
