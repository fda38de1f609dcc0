"""Tables written to the cluster's shared folder, to cut lineage in iterative operators (``lacuna.sources.staging``)."""

from lacuna.sources.staging import drop_staged as drop_tables
from lacuna.sources.staging import scratch, shared_dir
from lacuna.sources.staging import staged as materialize

__all__ = ["drop_tables", "materialize", "scratch", "shared_dir"]
