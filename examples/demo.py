"""Build an index over generated splats, ask it, and look a splat up: python examples/demo.py (from the repository's top)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from vecscene.operators.index import IndexConfig, SplatIndex  # noqa: E402
from vecscene.sources import splats  # noqa: E402


def main() -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ix = SplatIndex(spark, IndexConfig(n_coarse=10, n_fine=50, n_probe=5))
    ix.add_splats(splats.generate(spark, 1000))
    print(f"built in {ix.build():.1f} s: {ix.stats}")
    vector = ix.encode(ix.get(7)).first()["v"]
    ix.with_splats(ix.query(vector, 5)).select("rank", "id", "distance", "position").orderBy("rank").show(truncate=False)
    ix.query_with_details(vector, 5).orderBy("rank").show()
    ix.members(0).orderBy("place").show(5)
    print(f"mean query time {ix.stats.mean_query_seconds:.2f} s over {ix.stats.n_queries} queries")
    ix.clear()


if __name__ == "__main__":
    main()
