"""Fleet state analytics on Spark: plans and reports over fleets of database clusters."""
