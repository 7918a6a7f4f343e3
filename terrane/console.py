"""Interactive shell over the library: python -m terrane.console DATA_DIR"""

from __future__ import annotations

import cmd
import sys
from datetime import datetime, timezone

from pyspark.sql.functions import count, desc, lit, to_date

from .gate_cli import decide
from .operators import profile, scorecard
from .operators.ingest import POS, ingest_all, summary, validate_retry
from .operators.lineage import REGISTRY, registry
from .operators.quality import gold_rules, judge_volume, load_contract, null_rate, pii, run_checks, schema_drift
from .operators.resolution import ladder
from .session import build_session, table, work_dir
from .sources.storage import list_dirs
from .sources.zones import file_stats


class Console(cmd.Cmd):
    prompt = "terrane> "

    def __init__(self, data: str, spark=None, bronze: str | None = None, **kw):
        super().__init__(**kw)
        self.data, self.spark = data, spark or build_session()
        self.bronze = bronze or work_dir(self.spark, "bronze")

    def _t(self, name):
        return table(self.spark, self.data, name)

    def _say(self, text):
        print(text, file=self.stdout)

    def do_status(self, _):
        """The tables at hand, and the rows of each landed source."""
        self._say(f"data {self.data}")
        for d in list_dirs(self.spark, self.data):
            self._say(f"  {d.rstrip('/').rpartition('/')[2]}")
        self.do_bronze("")

    def do_ingest(self, folder):
        """Land the six sources from <folder>/<source>.csv; without a folder, validate the POS rows at hand."""
        if folder:
            for r in ingest_all(self.spark, folder, self.bronze, datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")):
                self._say(r)
        else:
            self._say(summary(validate_retry(self._t("pos"), POS, "pos")).first().asDict())

    def do_bronze(self, _):
        """Files and rows of every landed source."""
        for d in list_dirs(self.spark, self.bronze):
            n = file_stats(self.spark, f"{d}/kind=data").agg({"rows": "sum", "file": "count"}).first()
            self._say(f"{d.rstrip('/').rpartition('/')[2]:<12}{n[1]} files {n[0]} rows")

    def do_quality(self, _):
        """Quality rules on POS: missing keys, drift, volume, personal data."""
        pos = self._t("pos")
        daily = [r.n for r in pos.groupBy(to_date("ingested_at").alias("d")).agg(count(lit(1)).alias("n")).orderBy(desc("d")).limit(8).collect()]
        for r in run_checks(pos, [null_rate("customer_id", 0.4), schema_drift(pos.columns), pii("pos_row")]) + [judge_volume(daily)]:
            self._say(f"{'PASS' if r.passed else r.policy:<6}{r.rule_id} {'; '.join(r.violations)}")

    def do_hook(self, line):
        """The gate on a payload: hook {"table": ..., "rows": [...]}"""
        self._say(decide(self.spark, line))

    def do_gold(self, name):
        """Rules of a Gold contract."""
        for r in gold_rules(load_contract(name or "customer")):
            self._say(f"{r.policy:<6}{r.rule_id}")

    def do_scorecard(self, _):
        """The matcher against the labelled pairs."""
        self._say(scorecard.report(*scorecard.evaluate(self._t("golden_pair"), ladder)))

    def do_profile(self, _):
        """Health of the seven sources; those that are not there are reported."""
        sources = [profile.registered(n, "ingested_at" if n in ("pos", "crm") else None) for n in REGISTRY]
        rows, errors = profile.run_swarm(self._t, sources, datetime.now(timezone.utc))
        self._say(profile.bars(rows))
        for name, why in errors.items():
            self._say(f"{name:<12}{why}")

    def do_catalog(self, _):
        """Registered sources."""
        for r in registry(self.spark).orderBy("source").collect():
            self._say(f"{r.source:<10}{r.key:<20}{r.columns}")

    def do_full(self, line):
        """ingest, quality, scorecard, profile, status"""
        for step in (self.do_ingest, self.do_quality, self.do_scorecard, self.do_profile, self.do_status):
            step(line)

    def do_quit(self, _):
        """Leave."""
        return True

    do_exit = do_EOF = do_quit


if __name__ == "__main__":
    Console(sys.argv[1]).cmdloop()
