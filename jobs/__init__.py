"""Jobs that run by themselves: each has a function that takes a session, and a command line that makes one."""
