"""Reading and writing: text tables, matrices, pools and run state."""
