"""Where the given tables lie; a module of its own name, as every test folder may have a conftest."""

SF_SMALL = "/root/testdata/sf0.001"
