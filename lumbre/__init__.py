"""lumbre: table operators for cohort studies on PySpark."""
