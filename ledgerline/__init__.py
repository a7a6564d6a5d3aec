"""ledgerline: sales rollup and run-history analytics as Spark DataFrame plans.

Two kinds of work, both written with DataFrame / SQL built-ins only:

* the order pipeline: generate or read orders, check them against an explicit
  schema, roll completed orders up to revenue per region and product in exact
  decimal arithmetic, and publish the result under a pinned table contract;
* run-history analytics over job and run tables: name matching and resolution,
  duplicate-run blocking, duration estimates, latest/active runs, failure
  classification, failed-task selection and JSON summary flattening.
"""

from ledgerline.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
