"""finscan: declarative screening, bars, indicators, text feeds and streams over Spark tables."""
