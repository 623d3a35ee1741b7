"""Recipe-combination analytics on Spark: sources, operators, plans and streams over ``A + B -> C`` data."""
