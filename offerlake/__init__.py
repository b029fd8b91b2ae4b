"""offerlake: price-comparison analytics as Spark DataFrame operators.

Every public function takes DataFrames (and an explicit ``as_of``) and returns
a lazily evaluated DataFrame.  Nothing in the library calls an action unless
its name says so (``write_*``, ``export_*``, streaming starters).
"""
