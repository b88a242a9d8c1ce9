"""python -m corvane QUERY FOLDER: run a registered query over a folder of Parquet tables and show its first rows."""

import sys

from corvane.plans import catalogue, catalogue_more  # noqa: F401
from corvane.session import session

if __name__ == "__main__":
    if len(sys.argv) != 3 or sys.argv[1] not in catalogue.QUERIES:
        sys.exit(f"{__doc__}\nQueries: {', '.join(sorted(catalogue.QUERIES))}")
    catalogue.QUERIES[sys.argv[1]](session(), sys.argv[2]).show(20, truncate=80)
