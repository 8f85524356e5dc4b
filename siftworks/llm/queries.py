"""All query modules of the subpackage."""

from . import q01_truncation, q02_capping, q03_neardup, q04_stuffing, q05_pagebody, q06_sitelines, q08_packing, q09_leaks, q10_lookalike

MODULES = [q01_truncation, q02_capping, q03_neardup, q04_stuffing, q05_pagebody, q06_sitelines, q08_packing, q09_leaks, q10_lookalike]
