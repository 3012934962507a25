"""Errors that a statement can raise; none of them leaves a change behind."""


class EngineError(Exception):
    """Any failure of a statement."""


class SyntaxFailure(EngineError):
    """The text is no statement of the dialect."""


class AnalysisFailure(EngineError):
    """Names or types don't fit the tables."""


class ConstraintFailure(EngineError):
    """A primary key would be NULL or repeated."""


class ConflictFailure(EngineError):
    """Another writer committed first."""


class DeadlockFailure(EngineError):
    """Waiting for a lock would close a circle of waiting transactions."""
