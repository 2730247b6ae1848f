"""The shared folder comes from the session."""

import pytest

from lumbre import storage


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, setting=None, folder=None):
        self.sparkContext = Context(master, folder)
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}


def test_named_folder_is_used():
    session = Session("spark://host:7077", "s3a://bucket/shared")
    assert storage.shared_folder(session) == "s3a://bucket/shared"
    assert session.sparkContext.folder == "s3a://bucket/shared"
    assert storage.new_folder(session, "x").startswith("s3a://bucket/shared/lumbre/x-")


def test_folder_of_the_context_is_kept():
    session = Session("yarn", folder="hdfs:///chosen")
    assert storage.shared_folder(session) == "hdfs:///chosen"


def test_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session("yarn"))


def test_local_session_makes_its_own():
    session = Session("local[2]")
    assert storage.shared_folder(session) == session.sparkContext.folder == storage.shared_folder(session)
