"""SQL of all queries outside the training-data part, by name."""

from oracle import more, sql

ORACLES = {**sql.ORACLES, **more.ORACLES}
